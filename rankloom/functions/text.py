"""Scalar building blocks: tokens, n-grams, hashes, clamps, bands, year spans.

Everything is a Catalyst expression; no Python runs per row.  Inputs may be null:
text functions treat null as empty, numeric ones pass null on unless said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.config import DEFAULT

#: Letters, digits and underscores of any script; a word with accents is one token.
TOKEN = r"[\p{L}\p{N}_]+"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0))


def words(c: Column | str) -> Column:
    """Non-empty stretches between white space, lower-cased."""
    return F.filter(F.split(F.lower(text(c)), r"\s+"), lambda w: w != "")


def ngrams(ws: Column, n: int = 4) -> Column:
    """Runs of n words joined by blanks; empty where there are fewer.  ``ws`` should be a plain column: it is read per gram."""
    starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))


def unfolded(values: Column | str, name: str) -> Column:
    """A row for each of ``values``, and one of null where there are none; drop that one.

    For arrays that are costly to make: of a plain explode the optimizer infers a filter on the array's size and moves it
    below the projections, where the words of a text are cut again for every gram of it.
    """
    return F.explode_outer(values).alias(name)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))  # least() and greatest() pass over nulls


def bucket(x: Column, digits: int = 6) -> Column:
    """Half-up rounding by floor, the same in every engine for x >= 0 and stable for ranks of equal scores."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def content_hash(c: Column | str, length: int = 64) -> Column:
    return F.substring(F.sha2(text(c), 256), 1, length)


def tolerant_int(c: Column, low: int = 0, high: int = 50) -> Column:
    """An int from anything, 0 where there is none, clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.try_cast("int"), F.lit(0))))


def band(x: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """The name of the first step (highest bound first) that x reaches."""
    out = None
    for bound, name in steps:
        out = F.when(x >= bound, name) if out is None else out.when(x >= bound, name)
    return out.otherwise(below)


def contains_any(haystack: Column, needles: list[str]) -> Column:
    """Whether any needle occurs, sub-word hits included."""
    out = F.lit(False)
    for n in needles:
        out = out | haystack.contains(n)
    return out


def count_contained(haystack: Column, needles: list[str]) -> Column:
    out = F.lit(0)
    for n in needles:
        out = out + haystack.contains(n).cast("int")
    return out


#: Separator between the years of a span: three readings of it are in use.
SPAN_SEPARATORS = {"loose": r"[-–—to]+", "dashes": r"[-–—]+", "dash": r"[-–—]"}


def year_span(lowered: Column, separator: str = "dashes", as_of: int = DEFAULT.as_of_year) -> Column:
    """Latest end less earliest start of 20xx spans; 0 without any."""
    pattern = rf"(20[0-9]{{2}})\s*{SPAN_SEPARATORS[separator]}\s*(20[0-9]{{2}}|present|current|now)"
    starts = F.transform(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(1)), lambda y: y.cast("int"))
    ends = F.transform(
        F.regexp_extract_all(lowered, F.lit(pattern), F.lit(2)),
        lambda y: F.when(y.isin("present", "current", "now"), F.lit(as_of)).otherwise(y.try_cast("int")),
    )
    return F.coalesce(F.array_max(ends) - F.array_min(starts), F.lit(0))


def percent(x: Column, digits: int = 0) -> Column:
    """Half-up percentage label."""
    return F.concat(F.format_number(bucket(x * 100, digits), digits), F.lit("%"))


def progress(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.floor(100 * done / F.nullif(total, F.lit(0))).cast("int"))


def numeric_or_text_sort(c: Column) -> list[Column]:
    """Sort keys: numbers first in their order, then texts."""
    return [c.try_cast("double").asc_nulls_last(), c.asc_nulls_last()]
