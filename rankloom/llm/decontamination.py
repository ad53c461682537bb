"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Text is cut into tokens; numbers, capitalised names inside a sentence, and units
after a number become typed placeholders, everything else is lower-cased.  Each
run of ``WINDOW`` template tokens of a document is hashed and equi-joined with
the windows of the benchmark items (equal templates are confirmed on the tokens
themselves, so a hash collision cannot count).  Placeholders match any value of
their type, so a re-parameterised question still meets its item; slot
consistency then asks that among the windows judged together each value of a
slot in the item stands for one value in the document.  Windows are judged
together by occurrence, so that a second variant or a stray window elsewhere in
a document takes nothing from the first: those of one alignment (document
position less item position), those of neighbouring alignments (words put in or
left out: alignments no further apart than the item has windows), and all of a
pair.  Windows whose tokens equal the item's own never contradict each other and
are judged on their own too.  A pair is a leak where any of these sets is
consistent and covers at least ``COVER`` of the item, counted in windows or in
the tokens under them (one edited word breaks ``WINDOW`` windows but few tokens),
or where one alignment is consistent and has ``RUN`` matching tokens in a row, so
that a quotation of part of a long item counts; ``n_hit`` and ``n_slots`` are
those of the accepted set with the most windows.  Edits that leave no ``WINDOW``
tokens in a row are not seen.

Only windows of the (small) benchmark are broadcast, after counting them; beyond
``BROADCAST_WINDOWS`` the join shuffles on the hash.  Document windows are made
and probed inside one stage and never shuffled or stored in the broadcast case.

Defined results: null and empty texts have no windows and leak nothing; an item
shorter than a window is one window of its own length; items without tokens, or
made of placeholders only, are never matched; equal items each report; repeated
rows of a document report as one document; null ids are ignored; texts are read
whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import pick, table

WINDOW, COVER, RUN, BROADCAST_WINDOWS = 8, 0.5, 13, 200_000
#: A window needs at least this share of plain tokens; placeholders alone say nothing.
PLAIN = 0.5
# Units that may follow a number.
UNITS = (
    "mm cm m km inch inches ft feet foot yd yard yards mile miles mg g gram grams kg kilogram kilograms t ton tons lb lbs pound "
    "pounds oz ounce ounces ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hrs hour "
    "hours day days week weeks month months year years percent pct c f k w kw mw wh kwh v a hz khz mhz ghz b kb mb gb tb px mph kph "
    "kmh usd eur gbp dollar dollars cent cents euro euros"
).split()
NUMBER, NAME, UNIT = "§n", "§p", "§u"
#: Separators: anything but letters, marks, digits and the name mark; a point, comma, colon or slash only where not inside a number.
_CUT = r"(?:[^\p{L}\p{M}\p{N}§.,:/]|(?<!\p{N})[.,:/]|[.,:/](?!\p{N}))+"
#: A capitalised word that goes on a sentence: after a letter, digit or comma and one space.
_NAMED = r"(?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll})"


def tokens(text: Column) -> Column:
    """Lower-cased tokens, names marked by a leading section sign."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "§", " ")
    cut = F.split(F.lower(F.regexp_replace(plain, _NAMED, "§")), _CUT)
    return F.filter(cut, lambda t: t != "")


def template(raw: Column) -> Column:
    """Tokens with typed placeholders."""
    digit = lambda t: (t >= "0") & (t < ":")

    def one(t: Column, i: Column) -> Column:
        after_number = (i > 0) & digit(F.get(raw, i - 1))
        return F.when(t.startswith("§"), NAME).when(digit(t), NUMBER).when(t.isin(UNITS) & after_number, UNIT).otherwise(t)

    return F.transform(raw, one)


def _hashes(length: int) -> Column:
    """Hash of each window of ``length`` tokens of the column template, by position; null where it is too short."""
    starts = F.when(F.size("template") >= length, F.sequence(F.lit(1), F.size("template") - (length - 1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice("template", i, length)))


def _plain_enough(window: Column) -> Column:
    return F.size(F.filter(window, lambda t: ~t.startswith("§"))) >= F.greatest(F.lit(1), F.ceil(F.size(window) * PLAIN))


def _spans(starts: Column, length: Column) -> Column:
    """Tokens under the windows that start at ``starts``: how many (n_tokens), and how many in a row at most (run)."""

    def add(s: Column, at: Column) -> Column:
        fresh = F.least(length, at + length - 1 - s.end)
        run = F.when(at <= s.end + 1, s.run + fresh).otherwise(length)
        return F.struct((at + length - 1).alias("end"), run.alias("run"), F.greatest(s.run_most, run).alias("run_most"), (s.n_tokens + fresh).alias("n_tokens"))

    none = F.struct(*[F.lit(0).alias(n) for n in ("end", "run", "run_most", "n_tokens")])
    return F.aggregate(F.array_sort(starts), none, add)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n_windows, n_tokens, length, h, item_window, item_raw, item_at for items (item_id, text)."""
    made = (
        pick(items, "item_id", "text")
        .where("item_id is not null")
        .dropDuplicates(["item_id", "text"])
        .withColumn("raw", tokens(F.col("text")))
        .where(F.size("raw") > 0)
        # inside a document the item's first word may look like a name
        .withColumn("raw", F.explode(F.expr("array_distinct(array(raw, array_insert(slice(raw, 2, size(raw)), 1, concat('§', ltrim('§', raw[0])))))")))
        .withColumn("template", template(F.col("raw")))
        .withColumn("length", F.least(F.size("template"), F.lit(window)))
        .select("item_id", "raw", "template", "length", F.explode(F.expr("sequence(1, size(template) - length + 1)")).alias("item_at"))
        .select("item_id", "length", "item_at", F.expr("slice(template, item_at, length)").alias("item_window"), F.expr("slice(raw, item_at, length)").alias("item_raw"))
        .where(_plain_enough(F.col("item_window")))
        .dropDuplicates(["item_id", "item_at", "item_window", "item_raw"])
    )
    sizes = made.groupBy("item_id").agg(F.collect_set("item_at").alias("ats"), F.min("length").alias("least"))
    sizes = sizes.select("item_id", F.size("ats").alias("n_windows"), _spans(F.col("ats"), F.col("least")).n_tokens.alias("n_tokens"))
    return made.join(sizes, "item_id").withColumn("h", F.xxhash64("item_window"))


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, n_windows, n_hit, n_slots: leaks of items (item_id, text) in docs (doc_id, text)."""
    known = item_windows(items, window)
    # the benchmark's windows: counted before they may be broadcast
    sizes = {r["length"]: r["n"] for r in known.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    made = (
        pick(docs, "doc_id", "text")
        .where("doc_id is not null")
        .withColumn("raw", tokens(F.col("text")))
        .withColumn("template", template(F.col("raw")))
        # one array for every window length that the benchmark has: `window`, and those of shorter items
        .select("doc_id", "raw", "template", F.explode(F.array(*[F.struct(F.lit(n).alias("length"), _hashes(n).alias("hs")) for n in sorted(sizes) or [window]])).alias("of"))
        .select("doc_id", "raw", "template", "of.length", F.posexplode("of.hs").alias("at", "h"))
    )
    # `coalesce` keeps the comparison out of the join key: it is made for rows of equal hash only.  From the
    # generator to this projection all is generated code, so no row with a document's arrays is ever copied.
    hits = made.join(known.withColumnRenamed("length", "item_length"), "h").where(
        F.expr("length = item_length and coalesce(slice(template, at + 1, length) = item_window, false)")
    ).select("doc_id", "item_id", "n_windows", "n_tokens", "length", "at", "item_at", "item_window", "item_raw", F.expr("slice(raw, at + 1, length)").alias("doc_raw"))
    # slots: the values behind the placeholders of a window, and what they stand for in the item
    slots = F.filter(
        F.arrays_zip(F.col("item_window").alias("kind"), F.col("item_raw").alias("item"), F.col("doc_raw").alias("doc")),
        lambda s: s.kind.startswith("§"),
    )
    equal = F.col("item_raw") == F.col("doc_raw")
    windows = hits.select("doc_id", "item_id", "n_windows", "n_tokens", "length", (F.col("at") - F.col("item_at")).alias("align"), F.array("item_at").alias("ats"), slots.alias("slots"), equal.alias("equal")).select(
        "*", F.when(F.col("equal"), F.col("ats")).alias("equal_ats"), F.when(F.col("equal"), F.col("slots")).alias("equal_slots"), F.lit(None).cast("struct<n_hit:int,n_slots:int>").alias("best")
    )
    runs = _judge(windows, cover, "align")
    by_align = Window.partitionBy("doc_id", "item_id").orderBy("align")
    apart = F.coalesce(F.col("align") - F.lag("align").over(by_align) > F.col("n_windows"), F.lit(True))
    near = runs.withColumn("apart", apart.cast("int")).withColumn("place", F.sum("apart").over(by_align))
    pairs = _judge(_judge(near, cover, "place"), cover)
    return pairs.where("best is not null").select("doc_id", "item_id", "n_windows", "best.n_hit", "best.n_slots")


def _judge(rows: DataFrame, cover: float, *by: str) -> DataFrame:
    """The rows of each pair and ``by`` as one: their sets united, and the best consistent set so far that covers enough."""
    # sets: item positions, at most as many as the item has, and its slots within one document
    united = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    sets = rows.groupBy("doc_id", "item_id", "n_windows", "n_tokens", *by).agg(
        *[united(c) for c in ("ats", "slots", "equal_ats", "equal_slots")], F.min("length").alias("length"), F.max("best").alias("best")
    )

    def found(ats: str, slots: str) -> Column:
        # a slot breaks consistency where its item value stands for several document values
        values = F.array_distinct(F.transform(slots, lambda s: F.struct(s.kind, s.item)))
        spans = _spans(F.col(ats), F.col("length"))
        enough = (F.size(ats) >= F.lit(cover) * F.col("n_windows")) | (spans.n_tokens >= F.lit(cover) * F.col("n_tokens"))
        if "align" in by:  # elsewhere the tokens need not be in a row in the document
            enough |= spans.run_most >= RUN
        return F.when((F.size(ats) > 0) & enough & (F.size(slots) == F.size(values)), F.struct(F.size(ats).alias("n_hit"), F.size(slots).alias("n_slots")))

    return sets.withColumn("best", F.array_max(F.array("best", found("ats", "slots"), found("equal_ats", "equal_slots"))))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the whole benchmark in all documents, one row per document and item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL: dict[str, str] = {}
