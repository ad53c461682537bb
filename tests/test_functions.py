"""Dictionary matching, tree hashes and JSON repair against plain Python."""

import hashlib
import json
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from rankloom.functions.dictionary import Dictionary, Trie, profile_by_patterns
from rankloom.functions.json_repair import repair_json
from rankloom.functions.tree_hash import tree_hash
from rankloom.sources.readers import repair_json as repaired

TEXTS = ["", None, "a java script, javascript and C++ go", "ababab", "éab é", "go gone ago", "x" * 300]
FORMS = ["ab", "bab", "java", "javascript", "go", "é", "java script", "zzz", "", "ab"]


@pytest.mark.parametrize("library", [True, False])
def test_dictionary(spark, monkeypatch, library):
    if not library:
        monkeypatch.setitem(sys.modules, "ahocorasick", None)
        assert list(Trie(["ab", "b"]).found("abb")) == [(1, 0), (1, 1), (2, 1)]
    d = Dictionary(FORMS)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(3)
    for r in df.select("i", "t", d.contained(F.col("t")).alias("c"), d.occurrences(F.col("t")).alias("o"), d.longest(F.col("t")).alias("l"), d.words(F.col("t")).alias("w")).collect():
        t = r.t or ""
        assert r.c == sorted({f for f in FORMS if f and f in t})
        assert [(o.start, o.form) for o in r.o] == sorted(((m.start(), f) for f in set(FORMS) if f for m in re.finditer(f"(?={re.escape(f)})", t)), key=lambda x: (x[0], -len(x[1])))
        best = max(map(len, r.c), default=0)
        assert r.l == next((f for f in FORMS if f in r.c and len(f) == best), None)
        assert r.w == sorted({f for f in FORMS if f and re.search(rf"(?<![0-9a-z_]){re.escape(f)}(?![0-9a-z_])", t)})
    assert Dictionary.of(spark.createDataFrame([("b",), ("a",), (None,), ("",), ("a",)], "v string"), "v").forms == ["a", "b"]
    assert [r[0] for r in df.select(Dictionary([]).contained(F.col("t"))).collect()] == [[]] * len(TEXTS)


def test_profile_by_patterns(spark):
    text = "Python and C++, Node.js; 5+ years of experience, 12 years exp. AWS SAA, CKA cka; data  pipeline"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(profile_by_patterns(F.col("t")).alias("p")).collect()
    assert got[0].p.technical_skills == ["aws", "data  pipeline", "node.js", "python"] and got[0].p.certifications == ["aws saa", "cka"] and got[0].p.experience_years == 12
    assert got[1].p.technical_skills == [] and got[1].p.experience_years == 0 and got[1].p.domain == "unknown"


def tree(values, fan):
    while len(values) > 1:
        values = [v[0] if len(v) == 1 else hashlib.sha256(",".join(v).encode()).hexdigest() for v in (values[i : i + fan] for i in range(0, len(values), fan))]
    return values[0]


@pytest.mark.parametrize("fan", [2, 3, 1024])
def test_tree_hash(spark, fan):
    rnd = random.Random(fan)
    rows = [(rnd.choice(["a", "b", "c", None]), i, None if i % 11 == 0 else f"v{i % 5}") for i in range(90)] + [("lone", 1, "x")]
    got = {r.g: (r.n, r.hash) for r in tree_hash(spark.createDataFrame(rows, "g string, i int, v string").repartition(4), "g", ["i"], "v", fan).collect()}
    by = {}
    for g, _, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append(v or "")
    assert got == {g: (len(v), tree(v, fan)) for g, v in by.items()}


def test_repair_json(spark):
    whole = '{"a": [1, 2, {"b": "x, \\"y\\" {"}], "c": {"d": null, "e": true}, "f": "é\\\\"}'
    cases = [whole[:k] for k in range(1, len(whole) + 1)] + ['```json\n{"a": 1}\n```', "no json", "", '{"a": "x\\', "[1, 2,", '{"a"', '{"a": 1}}', "  {} "]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").coalesce(1).orderBy("i").select(repair_json(F.col("c"))).collect()]
    for case, mended in zip(cases, got, strict=True):
        if case.startswith("{") and case in whole:
            kept = json.loads(mended)  # every cut of an object gives an object again
            assert isinstance(kept, dict) and set(kept) <= {"a", "c", "f"}
        elif (want := repaired(case)) is not None:
            assert json.loads(mended) == want
    assert got[cases.index("no json")] is None and got[len(whole) - 1] == whole and spark.range(1).select(repair_json(F.lit(None).cast("string"))).first()[0] is None
