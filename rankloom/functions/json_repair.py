"""JSON that was cut off, mended in an expression.

One fold over the characters keeps a stack of open brackets and whether it stands inside
a string; what is open at the end is closed.  Where that is no JSON yet, a trailing comma
or an unfinished member goes first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?", ""), r"```\s*$", ""))


def open_ends(body: Column) -> Column:
    """struct(stack, quoted, escaped): the closing brackets still due, the next one first, and whether a string is open."""
    start = F.struct(F.lit("").alias("stack"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        plain = ~s.quoted & ~s.escaped
        closing = F.when(c == "{", "}").when(c == "[", "]")
        stack = (
            F.when(plain & closing.isNotNull(), F.concat(closing, s.stack))
            .when(plain & c.isin("}", "]"), F.substring(s.stack, 2, 1_000_000))
            .otherwise(s.stack)
        )
        quoted = F.when(s.escaped, s.quoted).when(c == '"', ~s.quoted).otherwise(s.quoted)
        return F.struct(stack.alias("stack"), quoted.alias("quoted"), (s.quoted & ~s.escaped & (c == "\\")).alias("escaped"))

    return F.aggregate(F.split(body, ""), start, step)


def repair_json(c: Column) -> Column:
    """JSON text out of fences and closed where it was cut; null where no cut explains it.

    Tried in turn: as it is; closed; without a trailing comma; without a last member or element that has no whole value.
    """
    body = without_fences(c)
    # the fold is made once: what depends on it reads a one-row array
    folded = F.array(F.struct(body.alias("body"), open_ends(body).alias("ends")))

    def tries(x: Column) -> Column:
        # an escape that was cut is no character
        text = F.when(x.ends.escaped, F.regexp_replace(x.body, r"\\$", "")).otherwise(x.body)
        whole = F.concat(text, F.when(x.ends.quoted, '"').otherwise(""))
        cuts = [whole, F.regexp_replace(whole, r",\s*$", ""), F.regexp_replace(whole, r',?\s*"[^"]*"?\s*:?\s*$', ""), F.regexp_replace(whole, r',?\s*("[^"]*"\s*:\s*)?[-+.0-9a-zA-Z]*$', "")]
        return F.filter(F.array(x.body, *[F.concat(t, x.ends.stack) for t in cuts]), lambda t: F.try_parse_json(t).isNotNull())

    return F.get(F.flatten(F.transform(folded, tries)), F.lit(0))
