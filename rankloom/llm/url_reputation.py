"""Empirical-Bayes host reputation: beta-binomial shrinkage host -> registered domain -> suffix.

Labelled page outcomes (bad or good) are summed by host, registered domain and
public suffix.  Going down from the global rate, every level is a beta prior for
the next one.  A prior's mean comes from the siblings alone (the parent's sums
less the child's own, shrunk the same way towards the level above), so a host
never confirms itself; its weight is a moment estimate of the overdispersion
among the children of one parent, and no more than the number of outcomes the
prior rests on, so a posterior is never narrower than its evidence.  A host is
blocked where the lower bound of its posterior bad rate (mean less ``z``
posterior deviations) exceeds ``bad_rate``; unless given, that is the rate whose
odds are ``WORSE`` times those of all outcomes together, so that how common bad
pages are in general blocks nobody, and hosts that do not differ all pass
(``usual_odds``).  Explicit rules win over reputation.

The registered domain is one label below the public suffix: the last label, or
the last two where they are in ``SUFFIXES`` (a parameter).  User names and ports
are left out; an address is a domain and suffix of its own.

Everything runs as aggregates and equi-joins; host sums are stored once.  Defined
results: a null url or one without ``://`` has an empty host and path and is
judged as the host ``''``; a page is what its page_id and host say, so rows that
repeat it add no evidence and are judged like it; an outcome with a null id or
value is no outcome; several outcomes of one page (say labels that are given
twice) all count; without outcomes every host has the prior rate 1/2 at the weight
of one outcome and passes; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, pick, table

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Public suffixes of two labels under which anyone may register.
SUFFIXES = (
    "ac.uk co.uk gov.uk me.uk org.uk com.au edu.au net.au org.au co.nz net.nz org.nz ac.jp co.jp ne.jp or.jp co.kr or.kr com.cn net.cn org.cn "
    "com.tw com.hk com.sg com.my co.id co.th co.in net.in org.in com.pk com.br net.br org.br com.ar com.mx com.co com.pe com.ve com.tr "
    "co.il org.il co.za com.eg com.ng com.sa com.ua com.pl com.pt com.es com.gr github.io gitlab.io blogspot.com wordpress.com"
).split()
WORSE, Z = 3.0, 1.645
BROADCAST_HOSTS = 500_000


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path of the column url."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return (
        pages.withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def rule_of(rules, host="host", path="path"):
    """(rule, verdict) struct of the longest fitting rule, else null."""
    found = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        h = F.col(host)
        fits = ((h == rule_host) | h.endswith(f".{rule_host}")) & F.col(path).startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_domain(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Adds domain and suffix of the column host."""
    site = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    last = lambda n: F.array_join(F.slice("_labels", F.greatest(F.size("_labels") - (n - 1), F.lit(1)), n), ".")
    two = last(2).isin(list(suffixes))
    address = F.col("_site").rlike(r"^[0-9.]*$|[:\[]")
    return (
        hosts.withColumn("_site", site)
        .withColumn("_labels", F.split("_site", r"\."))
        .withColumn("domain", F.when(address, F.col("_site")).when(two, last(3)).otherwise(last(2)))
        .withColumn("suffix", F.when(address, F.col("_site")).when(two, last(2)).otherwise(last(1)))
        .drop("_site", "_labels")
    )


def _weight(children: DataFrame) -> float:
    """Weight of the beta prior for rows (n, k, parent_n, parent_k).

    With m the rate of a child's siblings, (k - n m)^2 / (n m (1 - m)) is 1 + (n - 1) rho + n / siblings on average,
    and the weight is 1 / rho - 1; four sums reach the driver.  Only children with siblings tell anything.
    """
    rest = F.col("parent_n") - F.col("n")
    known = children.where((F.col("n") > 0) & (rest > 0)).withColumn("rest", rest).withColumn("m", (F.col("parent_k") - F.col("k") + 0.5) / (rest + 1))
    z = (F.col("k") - F.col("n") * F.col("m")) ** 2 / (F.col("n") * F.col("m") * (1 - F.col("m")))
    s = known.agg(
        F.coalesce(F.sum(z - 1 - F.col("n") / F.col("rest")), F.lit(0.0)).alias("z"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("room"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    ).first()
    most = max(1.0, float(s.n))
    rho = s.z / s.room if s.room else 0.0
    return min(most, max(1.0, 1 / rho - 1)) if rho > 0 else most


def _below(children: DataFrame, weight: float) -> DataFrame:
    """Adds m and v, mean and weight of the prior, to rows (n, k, parent_n, parent_k, parent_m, parent_v)."""
    rest = F.col("parent_n") - F.col("n") + F.col("parent_v")
    m = (F.col("parent_k") - F.col("k") + F.col("parent_v") * F.col("parent_m")) / rest
    return children.withColumn("m", m).withColumn("v", F.least(F.lit(weight), rest))


def host_reputation(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, n, k and the posterior parameters a and b, for kept rows (host, n, k): labelled pages and bad ones."""
    hosts = with_domain(hosts.select("host", "n", "k"), suffixes)
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = total(hosts, "domain", "suffix")
    tops = total(domains, "suffix")
    t = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()

    def of(children: DataFrame, parents: DataFrame, *key: str) -> DataFrame:
        names = [F.col(c).alias(f"parent_{c}") for c in ("n", "k", "m", "v") if c in parents.columns]
        return children.join(parents.select(*key, *names), list(key))

    under = tops.withColumns({"parent_n": F.lit(t.n), "parent_k": F.lit(t.k), "parent_m": F.lit(0.5), "parent_v": F.lit(1.0)})
    tops = _below(under, _weight(under))
    by_domain, by_host = _weight(of(domains, tops, "suffix")), _weight(of(hosts, domains, "domain", "suffix"))
    domains = _below(of(domains, tops, "suffix"), by_domain)
    hosts = _below(of(hosts, domains, "domain", "suffix"), by_host)
    return hosts.select("host", "n", "k", (F.col("k") + F.col("v") * F.col("m")).alias("a"), (F.col("n") - F.col("k") + F.col("v") * (1 - F.col("m"))).alias("b"))


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """Mean of a beta distribution less ``z`` deviations, at least 0."""
    return F.greatest(a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), F.lit(0.0))


def usual_odds(n: int, k: int, worse: float = WORSE) -> float:
    """The bad rate whose odds are ``worse`` times those of ``k`` bad ones among ``n`` outcomes."""
    odds = worse * (k + 0.5) / (n - k + 0.5)
    return odds / (1 + odds)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, bad_rate: float | None = None, z: float = Z, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_lower for pages (page_id, url) and outcomes (page_id, bad 0/1)."""
    parsed = with_host_path(pick(pages, "page_id", "url"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("k"))
    sums = (
        parsed.select("page_id", "host")
        .distinct()
        .join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    )
    scratch = Scratch(pages.sparkSession)
    hosts = scratch.keep(sums)
    if bad_rate is None:
        bad_rate = usual_odds(*hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first())
    judged = scratch.keep(host_reputation(hosts, suffixes).select("host", lower_bound(F.col("a"), F.col("b"), z).alias("bad_lower")))
    scratch.drop_all_but(judged)
    if judged.count() <= BROADCAST_HOSTS:
        judged = F.broadcast(judged)
    return (
        parsed.join(judged, "host", "left")
        .withColumn("hit", rule_of(rules))
        .select(
            "page_id", "host", "path", F.col("hit.rule").alias("rule"),
            F.coalesce("hit.verdict", F.when(F.col("bad_lower") > bad_rate, "block").otherwise("allow")).alias("verdict"),
            F.round("bad_lower", 6).alias("bad_lower"),
        )
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes (page_id, bad) of pages whose url ends in the id of the document they show, where it is labelled.

    A page is bad where its document is labelled of low quality or toxic.
    """
    shown = with_host_path(pick(pages, "page_id", "url")).select("page_id", F.regexp_extract("path", r"/([0-9]{1,18})(\.html)?/?$", 1).try_cast("long").alias("doc_id")).distinct()
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    return shown.join(labels.where("doc_id is not null").select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages, with the outcomes of the documents that labelled pages show."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def _oracle() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    cases = lambda i: " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[i]}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))

    def weight(children: str) -> str:
        return f"""(SELECT CASE WHEN room > 0 AND z / room > 0 THEN least(most, greatest(1.0, room / z - 1)) ELSE most END FROM (
          SELECT coalesce(sum((k - n * m) ** 2 / (n * m * (1 - m)) - 1 - n / rest), 0.0) AS z, coalesce(sum(n - 1), 0.0) AS room, greatest(1.0, coalesce(sum(n), 0.0)) AS most
          FROM (SELECT *, (pk - k + 0.5) / (rest + 1) AS m FROM (SELECT *, pn - n AS rest FROM {children}) WHERE n > 0 AND rest > 0)))"""

    def below(children: str) -> str:
        return f"""SELECT *, (pk - k + pv * pm) / (pn - n + pv) AS m, least({weight(children)}, pn - n + pv) AS v FROM {children}"""

    return f"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
outcomes AS (
  SELECT page_id, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END AS bad
  FROM (SELECT DISTINCT page_id, try_cast(regexp_extract(path, '/([0-9]{{1,18}})(\\.html)?/?$', 1) AS BIGINT) AS doc_id FROM parsed) JOIN labels USING (doc_id) WHERE page_id IS NOT NULL),
known AS (SELECT page_id, count(*) AS n, sum(bad) AS k FROM outcomes GROUP BY page_id),
sums AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM (SELECT DISTINCT page_id, host FROM parsed) LEFT JOIN known USING (page_id) GROUP BY host),
usual AS (SELECT {WORSE} * (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) - coalesce(sum(k), 0) + 0.5) AS odds FROM sums),
sites AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS site FROM sums),
parts AS (SELECT *, string_split(site, '.') AS l, regexp_matches(site, '^[0-9.]*$|[:\\[]') AS address FROM sites),
lasts AS (SELECT *, array_to_string(l[-1:], '.') AS one, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three FROM parts),
hosts AS (
  SELECT host, n, k, CASE WHEN address THEN site WHEN two IN ({listed}) THEN three ELSE two END AS domain,
    CASE WHEN address THEN site WHEN two IN ({listed}) THEN two ELSE one END AS suffix FROM lasts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
tops0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
tops1 AS (SELECT *, (SELECT sum(n) FROM tops0) AS pn, (SELECT sum(k) FROM tops0) AS pk, 0.5 AS pm, 1.0 AS pv FROM tops0),
tops AS ({below("tops1")}),
domains1 AS (SELECT d.*, t.n AS pn, t.k AS pk, t.m AS pm, t.v AS pv FROM domains d JOIN tops t USING (suffix)),
domains2 AS ({below("domains1")}),
hosts1 AS (SELECT h.*, d.n AS pn, d.k AS pk, d.m AS pm, d.v AS pv FROM hosts h JOIN domains2 d USING (domain, suffix)),
hosts2 AS ({below("hosts1")}),
beta AS (SELECT host, k + v * m AS a, n - k + v * (1 - m) AS b FROM hosts2),
judged AS (SELECT host, greatest(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0.0) AS bad_lower FROM beta)
SELECT page_id, host, path, CASE {cases(0)} END AS rule,
  CASE {cases(1)} WHEN bad_lower > odds / (1 + odds) THEN 'block' ELSE 'allow' END AS verdict, round(bad_lower, 6) AS bad_lower
FROM parsed LEFT JOIN judged USING (host), usual
"""


QUERIES = {"op7_url_reputation": op7_url_reputation}
ORACLE_SQL = {"op7_url_reputation": _oracle()}
