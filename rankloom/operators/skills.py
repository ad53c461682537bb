"""Skill graph: small relational tables, one-hop expansion, tiered matching, canonical names.

The graph is data: pass your own rows, or use the small seed below.  Its tables come
from the driver and are broadcast; what grows with the queries is broadcast only where its
size was counted first; documents are the large side everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import ngrams, text
from rankloom.operators.retrieval import _small

#: surface | canonical | group | importance | adjacent canonicals | parents
SEED = """
python|python|language|5|django,flask|software
go|go|language|4|rust|software
golang|go|language|4|rust|software
java|java|language|5|kotlin,spring|software
kotlin|kotlin|language|3|java|software
rust|rust|language|3|go|software
typescript|typescript|language|4|javascript,react|software,web
javascript|javascript|language|4|typescript,react|software,web
django|django|web_framework|4|python,flask|web
flask|flask|web_framework|3|python,django|web
spring|spring|web_framework|4|java|web
react|react|frontend|4|javascript,typescript|web
postgres|postgresql|database|5|mysql|data
postgresql|postgresql|database|5|mysql|data
mysql|mysql|database|4|postgresql|data
redis|redis|cache|4|postgresql|data
kafka|kafka|queue|5|rabbitmq|distributed
rabbitmq|rabbitmq|queue|4|kafka|distributed
docker|docker|container|5|kubernetes|infrastructure
k8s|kubernetes|container|5|docker|infrastructure
kubernetes|kubernetes|container|5|docker|infrastructure
terraform|terraform|infrastructure_code|4|kubernetes|infrastructure
aws|aws|cloud|5|gcp,azure|infrastructure
gcp|gcp|cloud|4|aws|infrastructure
azure|azure|cloud|4|aws|infrastructure
spark|spark|pipeline|4|airflow|data
airflow|airflow|pipeline|4|spark|data
pytorch|pytorch|learning|4|tensorflow|ai
tensorflow|tensorflow|learning|4|pytorch|ai
"""


@dataclass(frozen=True)
class Graph:
    """skill (surface, canonical, grp, importance, pos), adjacent (canonical, adj), parent (canonical, parent)."""

    skill: DataFrame
    adjacent: DataFrame
    parent: DataFrame
    surfaces: tuple[str, ...]


def skill_graph(spark: SparkSession, rows: str = SEED) -> Graph:
    """A graph from lines of the form of SEED; a canonical's attributes are those of its first surface, self links go."""
    parsed = [tuple(x.split("|")) for x in rows.strip().splitlines()]
    skill = [(s, c, g, int(i), k) for k, (s, c, g, i, _, _) in enumerate(parsed)]
    first: dict[str, tuple] = {}
    for r in parsed:
        first.setdefault(r[1], r)
    adjacent = [(c, a) for c, r in first.items() for a in r[4].split(",") if a and a != c and a in first]
    parent = [(c, p) for c, r in first.items() for p in r[5].split(",") if p]
    return Graph(
        spark.createDataFrame(skill, "surface string, canonical string, grp string, importance int, pos int"),
        spark.createDataFrame(adjacent, "canonical string, adj string"),
        spark.createDataFrame(parent, "canonical string, parent string"),
        tuple(s for s, *_ in skill),
    )


def extract_skills(docs: DataFrame, graph: Graph) -> DataFrame:
    """doc_id, canonical: surface forms found at word boundaries, those of several words too, by an equi-join on runs of tokens."""
    most = max((len(x.split()) for x in graph.surfaces), default=1)
    cut = docs.select("doc_id", F.regexp_extract_all(F.lower(text("text")), F.lit(r"[a-z0-9_+#./-]*[a-z0-9_+#]"), F.lit(0)).alias("_ts"))
    runs = F.concat("_ts", *[ngrams(F.col("_ts"), k) for k in range(2, most + 1)]) if most > 1 else F.col("_ts")
    of = cut.select("doc_id", F.explode(F.array_distinct(runs)).alias("surface"))
    return of.join(F.broadcast(graph.skill.select("surface", "canonical")), "surface").select("doc_id", "canonical").distinct()


def expand_with_parents(skills: DataFrame, graph: Graph) -> DataFrame:
    """doc_id, skill: the skills and one level of parents."""
    up = skills.join(F.broadcast(graph.parent), "canonical").select("doc_id", F.col("parent").alias("skill"))
    return skills.select("doc_id", F.col("canonical").alias("skill")).union(up).distinct()


def importance(skills: DataFrame, graph: Graph, default: float = 0.6) -> DataFrame:
    """Adds weight: importance / 5 of the canonical's first surface, or the default."""
    first = graph.skill.groupBy("canonical").agg(F.min_by("importance", "pos").alias("importance"))
    return skills.join(F.broadcast(first), "canonical", "left").withColumn("weight", F.coalesce(F.col("importance") / 5, F.lit(default))).drop("importance")


#: Credit by tier and level (fixed values).
CREDIT = {
    "exact": {"BUILT_WITH": 1.0, "USED": 0.7, "LISTED": 0.3},
    "adjacent": {"BUILT_WITH": 0.6, "USED": 0.5, "LISTED": 0.2},
    "group": {"BUILT_WITH": 0.3, "USED": 0.25, "LISTED": 0.1},
}
TIERS = ("exact", "adjacent", "group")


def tiered_match(wanted: DataFrame, owned: DataFrame, graph: Graph) -> DataFrame:
    """query_id, doc_id, skill, match_type, matched, credit: the first tier that matches, then best credit, then name.

    wanted: query_id, skill, weight.  owned: doc_id, skill, level.  Pairs without any match are absent from the result.
    """
    of = graph.skill.groupBy("canonical").agg(F.min_by("grp", "pos").alias("grp"))
    near = wanted.join(F.broadcast(graph.adjacent), wanted.skill == graph.adjacent.canonical).select("query_id", "skill", "weight", F.col("adj").alias("via"), F.lit(1).alias("tier"))
    same = wanted.select("query_id", "skill", "weight", F.col("skill").alias("via"), F.lit(0).alias("tier"))
    mine, theirs = of.select(F.col("canonical").alias("skill"), "grp"), of.select(F.col("canonical").alias("via"), "grp")
    group = wanted.join(F.broadcast(mine), "skill").join(F.broadcast(theirs), "grp").where("via <> skill").select("query_id", "skill", "weight", "via", F.lit(2).alias("tier"))
    routes = same.union(near).union(group)
    credit = F.lit(None).cast("double")
    for i, tier in enumerate(TIERS):
        for level, value in CREDIT[tier].items():
            credit = F.when((F.col("tier") == i) & (F.col("level") == level), value).otherwise(credit)
    best = Window.partitionBy("query_id", "doc_id", "skill").orderBy("tier", F.desc("credit"), "via")
    found = owned.withColumnRenamed("skill", "via").join(_small(routes), "via").withColumn("credit", credit).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    name = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1)
    return found.select("query_id", "doc_id", "skill", "weight", name.alias("match_type"), F.col("via").alias("matched"), "credit")


def coverage(matches: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, d1, core_coverage for every pair: weighted credit over all wanted skills."""
    core = F.col("weight") >= 2
    total = wanted.groupBy("query_id").agg(F.sum("weight").alias("w"), F.sum(core.cast("int")).alias("n_core"))
    got = matches.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("credit")).alias("got"), F.sum((core & (F.col("credit") > 0)).cast("int")).alias("core"))
    pairs = docs.select("doc_id").crossJoin(_small(total))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(F.coalesce(a, F.lit(0)) / F.when(b == 0, 1).otherwise(b))
    return pairs.join(got, ["query_id", "doc_id"], "left").select("query_id", "doc_id", safe(F.col("got"), F.col("w")).alias("d1"), safe(F.col("core"), F.col("n_core")).alias("core_coverage"))


def overlap(wanted: DataFrame, owned: DataFrame, graph: Graph) -> DataFrame:
    """query_id, doc_id, exact, adjacent, grouped, missing lists and combined = (exact + .6 adjacent + .3 group) / wanted, at most 1."""
    levels = owned.select("doc_id", F.col("skill")).withColumn("level", F.lit("BUILT_WITH"))
    m = tiered_match(wanted.withColumn("weight", F.lit(1.0)), levels, graph)
    lists = [F.sort_array(F.collect_set(F.when(F.col("match_type") == t, F.col("skill")))).alias(t) for t in TIERS]
    by = m.groupBy("query_id", "doc_id").agg(*lists)
    of = wanted.groupBy("query_id").agg(F.sort_array(F.collect_set("skill")).alias("wanted"))
    score = (F.size("exact") + 0.6 * F.size("adjacent") + 0.3 * F.size("group")) / F.size("wanted")
    return by.join(_small(of), "query_id").select(
        "query_id", "doc_id", "exact", "adjacent", F.col("group").alias("grouped"),
        F.array_except("wanted", F.concat("exact", "adjacent", "group")).alias("missing"), F.least(F.lit(1.0), score).alias("combined"),
    )


# Further names of skills; they go before what the graph says.
ALIASES = {
    "node.js": "node", "nodejs": "node",
    "rest api": "rest_api", "rest apis": "rest_api", "restful": "rest_api", "restful api": "rest_api",
    "sql": "sql", "nosql": "mongodb",
    "event-driven": "event_driven", "event driven": "event_driven",
    "microservice": "microservices", "micro-services": "microservices", "distributed systems": "distributed_systems",
    "ci cd": "ci_cd", "cicd": "ci_cd", "continuous integration": "ci_cd",
    "machine learning": "machine_learning", "deep learning": "deep_learning",
    "data pipeline": "data_pipeline", "data pipelines": "data_pipeline",
    "scikit-learn": "scikit_learn", "scikit learn": "scikit_learn",
}
# Separators of compound names, the first that occurs is the one that counts.
SEPARATORS = ("/", ",", " and ", " or ")


def canonical_map(rows: str = SEED) -> dict[str, str]:
    """Names of a graph's lines: surfaces own their canonical, neighbours without a line of their own go to the first that names them."""
    parsed = [x.split("|") for x in rows.strip().splitlines()]
    found = {}
    for surface, name, _, _, near, _ in parsed:
        found[surface] = name
        for other in near.split(","):
            if other and other not in found:
                found[other] = name
    return found | {surface: name for surface, name, *_ in parsed} | ALIASES


def canonical(name: Column, alias: dict[str, str], keys: dict[str, str], min_key: int = 1) -> Column:
    """Alias, exact key, first known part of a compound, longest key contained either way, else the name itself; '' below two characters.

    The first part of a compound without any known part is looked up in turn.  Of keys of one length the first counts.
    """
    table = F.create_map(*[F.lit(v) for kv in (keys | alias).items() for v in kv]) if keys or alias else None
    lookup = lambda x: F.try_element_at(table, x) if table is not None else F.lit(None).cast("string")
    ordered = sorted((k for k in keys if len(k) >= min_key), key=lambda k: -len(k))
    longest = F.array(*[F.lit(k) for k in ordered]) if ordered else F.array().cast("array<string>")

    def alone(x: Column) -> Column:
        near = lookup(F.get(F.filter(longest, lambda k: x.contains(k) | k.contains(x)), F.lit(0)))
        return F.when(F.length(x) < 2, "").otherwise(F.coalesce(lookup(x), near, x))

    def resolve(x: Column, separators: tuple[str, ...]) -> Column:
        if not separators:
            return alone(x)
        parts = F.filter(F.transform(F.split(x, separators[0]), lambda p: F.trim(p)), lambda p: p != "")
        known = F.get(F.filter(F.transform(parts, lookup), lambda v: v.isNotNull()), F.lit(0))
        first = F.get(parts, F.lit(0))
        inside = F.coalesce(known, F.nullif(resolve(first, separators[1:]), F.lit("")), first, x)
        return F.when(x.contains(separators[0]), inside).otherwise(resolve(x, separators[1:]))

    n = F.trim(F.lower(text(name)))
    return F.when(F.length(n) < 2, "").otherwise(F.coalesce(lookup(n), resolve(n, SEPARATORS)))
