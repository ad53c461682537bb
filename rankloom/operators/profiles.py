"""Coercion of loosely typed profiles into fixed structs: caps, clamps, defaults, evidence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import text, tolerant_int

LEVELS, IMPORTANCE = ["BUILT_WITH", "USED", "LISTED"], ["core", "nice"]
# Names of levels.
SENIORITY = {
    "junior": "junior", "jr": "junior", "entry": "junior",
    "mid": "mid", "mid-level": "mid", "middle": "mid",
    "senior": "senior", "sr": "senior",
    "staff": "staff", "principal": "staff",
    "lead": "lead", "tech lead": "lead",
    "executive": "executive", "director": "executive", "vp": "executive",
}
# Names of domains; functions of people are no domain.
DOMAINS = {
    "fintech": "fintech", "payments": "fintech", "banking": "fintech", "financial": "fintech", "financial services": "fintech",
    "fintech/payments": "fintech", "fintech payments": "fintech",
    "enterprise_saas": "enterprise_saas", "enterprise": "enterprise_saas", "saas": "enterprise_saas", "b2b": "enterprise_saas",
    "ai_ml": "ai_ml", "ai": "ai_ml", "machine learning": "ai_ml", "ml": "ai_ml", "nlp": "ai_ml",
    "healthcare": "healthcare", "medical": "healthcare",
    "platform_devops": "platform_devops", "platform": "platform_devops", "devops": "platform_devops", "infrastructure": "platform_devops",
    "ecommerce": "ecommerce", "marketplace": "ecommerce", "retail": "ecommerce",
    "backend development": "other", "backend": "other", "frontend development": "other", "frontend": "other", "fullstack": "other",
    "full stack": "other", "software engineering": "other", "product development": "other", "engineering": "other",
}

QUERY_PROFILE = "struct<required_skills:array<struct<name:string,importance:string>>,years_required:string,domain:string,seniority:string,hard_constraints:array<string>>"
DOC_PROFILE = "struct<skills:array<struct<name:string,level:string,evidence:string>>,total_years:string,domains:array<string>,seniority_signals:struct<leadership:string,architecture:string,scale:string,ownership:string>,highlights:array<string>>"


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(text(c)))), F.lit(default))


def canonical_domain(c: Column) -> Column:
    return lookup(c, DOMAINS, "other")


def canonical_seniority(c: Column) -> Column:
    return lookup(c, SENIORITY, "mid")


def one_of(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(allowed), c).otherwise(default)


def is_verbatim(evidence: Column, source: Column) -> Column:
    """Whether the evidence, or its first 50 characters, occurs in the source (white space and case aside)."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(text(c), r"\s+", " ")))
    return (flat(evidence) != "") & (flat(source).contains(flat(evidence)) | text(source).contains(F.substring(text(evidence), 1, 50)))


def normalize_query_profile(df: DataFrame, column: str = "profile") -> DataFrame:
    """At most 15 skills and 10 constraints, years 0 to 50, canonical domain and level; ``column`` is QUERY_PROFILE."""
    p = F.col(column)
    skills = F.slice(F.filter(p.required_skills, lambda s: F.trim(text(s["name"])) != ""), 1, 15)
    return df.withColumn(column, F.struct(
        F.transform(skills, lambda s: F.struct(F.lower(F.trim(s["name"])).alias("name"), one_of(s.importance, IMPORTANCE, "nice").alias("importance"))).alias("required_skills"),
        tolerant_int(p.years_required).alias("years_required"), canonical_domain(p.domain).alias("domain"),
        canonical_seniority(p.seniority).alias("seniority"), F.slice(F.coalesce(p.hard_constraints, F.array().cast("array<string>")), 1, 10).alias("hard_constraints"),
    ))


def normalize_doc_profile(df: DataFrame, column: str = "profile", source: str = "text") -> DataFrame:
    """Evidence that is not in the source is dropped and its level falls to LISTED; ``column`` is DOC_PROFILE."""
    p, src = F.col(column), F.col(source)

    def skill(s: Column) -> Column:
        real = is_verbatim(s.evidence, src)
        return F.struct(
            F.lower(F.trim(s["name"])).alias("name"), F.when(real, one_of(s.level, LEVELS, "LISTED")).otherwise("LISTED").alias("level"),
            F.when(real, s.evidence).otherwise("").alias("evidence"),
        )

    domains = F.slice(F.array_distinct(F.transform(F.coalesce(p.domains, F.array().cast("array<string>")), canonical_domain)), 1, 5)
    real_domains = F.filter(domains, lambda d: d != "other")
    cut = lambda c: F.substring(text(c), 1, 400)
    signals = p.seniority_signals
    return df.withColumn(column, F.struct(
        F.slice(F.transform(F.filter(p.skills, lambda s: F.trim(text(s["name"])) != ""), skill), 1, 15).alias("skills"),
        tolerant_int(p.total_years).alias("total_years"), F.when(F.size(real_domains) == 0, F.array(F.lit("other"))).otherwise(real_domains).alias("domains"),
        F.struct(*[cut(signals[k]).alias(k) for k in ("leadership", "architecture", "scale", "ownership")]).alias("seniority_signals"),
        F.slice(F.coalesce(p.highlights, F.array().cast("array<string>")), 1, 12).alias("highlights"),
    ))


def evidence_text(p: Column) -> Column:
    """All of a document profile that constraints may look at, lower-cased."""
    years = F.when(p.total_years > 0, F.concat(p.total_years.cast("string"), F.lit(" years")))
    skills = F.flatten(F.transform(F.slice(p.skills, 1, 15), lambda s: F.array(s["name"], s.evidence)))
    s = p.seniority_signals
    return F.lower(F.concat_ws(" ", years, F.array_join(skills, " "), F.array_join(p.highlights, " "), s.leadership, s.architecture, s.scale, s.ownership))
