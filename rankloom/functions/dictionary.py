"""Many surface forms found in texts by one automaton, whatever their number.

A text is read once, in Arrow batches of bounded rows and bytes; the automaton goes to the executors as one
broadcast whose size is checked.  Matches may overlap: every occurrence of every form is
found, inside words too.  Where the automaton library is missing, the forms are tried as
a trie of plain dictionaries, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.shared import bound_batches

#: Characters of all forms together that one automaton may hold (about 40 bytes each).
MOST_CHARS = 20_000_000


class Trie:
    """All forms by their characters; finds (place, form) with a walk from each place."""

    def __init__(self, forms: list[str]):
        self.root: dict = {}
        for k, form in enumerate(forms):
            node = self.root
            for c in form:
                node = node.setdefault(c, {})
            node[""] = k

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        for start in range(len(text)):
            node, at = self.root, start
            while at < len(text) and (node := node.get(text[at])) is not None:
                at += 1
                if (k := node.get("")) is not None:
                    yield at - 1, k


def automaton(forms: list[str]):
    """An object whose ``found`` gives (last place, form number) of every occurrence."""
    try:
        import ahocorasick
    except ImportError:
        return Trie(forms)
    made = ahocorasick.Automaton()
    for k, form in enumerate(forms):
        made.add_word(form, k)
    made.make_automaton()

    class Found:
        def found(self, text: str) -> Iterable[tuple[int, int]]:
            return made.iter(text)

    return Found() if forms else Trie(forms)


class Dictionary:
    """Forms (non-empty, distinct, in the order given) that columns are searched for."""

    def __init__(self, forms: Iterable[str]):
        self.forms = list(dict.fromkeys(f for f in forms if f))
        if sum(map(len, self.forms)) > MOST_CHARS:
            raise ValueError(f"forms of more than {MOST_CHARS} characters: split them, or join word n-grams instead")

    @staticmethod
    def of(df: DataFrame, column: str) -> Dictionary:
        """The distinct values of a column; their size is checked before they are fetched."""
        values = df.select(F.col(column).alias("v")).where("v IS NOT NULL AND v <> ''").distinct()
        size = values.agg(F.coalesce(F.sum(F.length("v")), F.lit(0))).first()[0]
        if size > MOST_CHARS:
            raise ValueError(f"forms of {size} characters, more than {MOST_CHARS}: split them, or join word n-grams instead")
        return Dictionary([r.v for r in values.orderBy("v").collect()])

    def _udf(self, kind: str, shape):
        spark = SparkSession.active()
        # what is found in a text can be many times its size, and a batch holds it for all of its rows
        bound_batches(spark)
        sent = spark.sparkContext.broadcast(self.forms)

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            machine = automaton(sent.value)
            for texts in batches:
                yield pd.Series([shape(machine.found(t), sent.value) if isinstance(t, str) and t else [] for t in texts])

        return run

    def contained(self, text: Column) -> Column:
        """The forms that occur in a text, each once, by name."""
        return self._udf("array<string>", lambda found, forms: sorted({forms[k] for _, k in found}))(text)

    def occurrences(self, text: Column) -> Column:
        """(start, form) of every occurrence, from the left, of one start the longest first."""
        shape = lambda found, forms: [{"start": a, "form": f} for a, _, f in sorted((at - len(forms[k]) + 1, -len(forms[k]), forms[k]) for at, k in found)]
        return self._udf("array<struct<start:int,form:string>>", shape)(text)

    def longest(self, text: Column) -> Column:
        """The longest form that a text contains, of equal lengths the one given first; null without any."""

        def shape(found, forms):
            best = min(((-len(forms[k]), k) for _, k in found), default=None)
            return [] if best is None else [forms[best[1]]]

        return F.get(self._udf("array<string>", shape)(text), F.lit(0))

    def words(self, text: Column, boundary: str = "0-9a-z_") -> Column:
        """The forms that occur between characters other than those of ``boundary``, each once, by name."""
        at = F.transform(
            F.filter(
                self.occurrences(text),
                lambda o: (~F.regexp_like(F.substring(text, o.start, F.when(o.start > 0, 1).otherwise(0)), F.lit(f"[{boundary}]")))
                & (~F.regexp_like(F.substring(text, o.start + F.length(o.form) + 1, F.lit(1)), F.lit(f"[{boundary}]"))),
            ),
            lambda o: o.form,
        )
        return F.sort_array(F.array_distinct(at))


# Patterns of technical names, years and certificates in lower-cased profile texts.
TECHNOLOGIES = [
    r"\b(python|java|javascript|typescript|go|rust|c\+\+|ruby|scala|kotlin)\b",
    r"\b(react|angular|vue|django|flask|fastapi|spring|node\.?js)\b",
    r"\b(aws|gcp|azure|docker|kubernetes|k8s|terraform)\b",
    r"\b(postgresql|mysql|mongodb|redis|kafka|rabbitmq|elasticsearch)\b",
    r"\b(etl|data\s*pipeline|data\s*ingestion|airflow|spark)\b",
    r"\b(graphql|grpc|microservice|distributed\s*system)\b",
]
YEARS = r"(\d+)\+?\s*years?\s*(?:of\s*)?(?:experience|exp)"
CERTIFICATES = r"\b(aws\s*(?:saa|sap|dva)|cissp|pmp|cka|ckad)\b"


def profile_by_patterns(text: Column) -> Column:
    """A struct of what patterns alone tell of a profile: skills, certificates, years; domain and seniority stay unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))
    years = F.transform(every(YEARS), lambda y: y.try_cast("int"))
    return F.struct(
        F.sort_array(F.array_distinct(F.flatten(F.array(*[every(p) for p in TECHNOLOGIES])))).alias("technical_skills"),
        F.sort_array(F.array_distinct(every(CERTIFICATES))).alias("certifications"),
        F.coalesce(F.array_max(years), F.lit(0)).alias("experience_years"),
        F.lit("unknown").alias("domain"),
        F.lit("unknown").alias("seniority"),
    )
