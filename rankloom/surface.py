"""The library in SQL: scalar functions, table functions, a table function over archives and a data source.

``register`` makes them known to a session; everything but the two that read bytes is an
expression or a query, so it is optimised with the statement that calls it.

    register(spark)
    tables(spark, documents, queries)
    spark.sql("SELECT query_id, doc_id, rl_bucket(score, 4) FROM rl_bm25() WHERE rl_sigmoid(score) > 0.5")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from rankloom.config import DEFAULT
from rankloom.operators.retrieval import is_small, query_terms

#: name(parameters) -> type: expression.  They say in SQL what ``functions.text`` says with columns.
SCALARS = {
    "rl_tokens(s STRING)": ("ARRAY<STRING>", r"regexp_extract_all(lower(coalesce(s, '')), '[\\p{L}\\p{N}_]+', 0)"),
    "rl_words(s STRING)": ("ARRAY<STRING>", r"filter(split(lower(coalesce(s, '')), '\\s+'), w -> w <> '')"),
    "rl_ngrams(ws ARRAY<STRING>, n INT)": ("ARRAY<STRING>", "CASE WHEN size(ws) >= n THEN transform(sequence(1, size(ws) - n + 1), i -> array_join(slice(ws, i, n), ' ')) ELSE CAST(array() AS ARRAY<STRING>) END"),
    "rl_content_hash(s STRING)": ("STRING", "sha2(coalesce(s, ''), 256)"),
    "rl_sigmoid(x DOUBLE)": ("DOUBLE", "1 / (1 + exp(-x))"),
    "rl_logit(p DOUBLE)": ("DOUBLE", "ln(p / (1 - p))"),
    "rl_clamp(x DOUBLE, low DOUBLE, high DOUBLE)": ("DOUBLE", "CASE WHEN x IS NOT NULL THEN greatest(low, least(high, x)) END"),
    "rl_bucket(x DOUBLE, digits INT)": ("DOUBLE", "floor(x * power(10, digits) + 0.5) / power(10, digits)"),
    "rl_tolerant_int(s STRING, low INT, high INT)": ("INT", "greatest(low, least(high, coalesce(try_cast(s AS INT), 0)))"),
    "rl_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"),
}
#: Where the terms of all queries are few, they go to the postings, and pairs are summed where their document is.
FEW_TERMS = "/*+ BROADCAST(q, w) */"
#: name(parameters) -> columns: query over the views that ``tables`` makes.
TABLES = {
    # dealt by document as texts, which are shorter than their tokens: what is counted or summed a document is not sent again
    "rl_postings()": (
        "doc_id BIGINT, term STRING, tf BIGINT, dl INT",
        """SELECT doc_id, term, count(*), first(dl) FROM (SELECT doc_id, size(ts) AS dl, explode_outer(ts) AS term FROM (SELECT doc_id, rl_tokens(text) AS ts
        FROM (SELECT /*+ REPARTITION(doc_id) */ doc_id, text FROM rl_documents))) WHERE term IS NOT NULL GROUP BY doc_id, term""",
    ),
    "rl_idf()": (
        "term STRING, df BIGINT, idf DOUBLE",
        f"""WITH raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM rl_postings() GROUP BY term) CROSS JOIN (SELECT count(*) AS n FROM rl_documents))
        SELECT term, df, CASE WHEN raw < 0 THEN {DEFAULT.bm25_epsilon} * mean ELSE raw END FROM raw CROSS JOIN (SELECT avg(raw) AS mean FROM raw)""",
    ),
    "rl_bm25()": (
        "query_id BIGINT, doc_id BIGINT, score DOUBLE",
        f"""WITH q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, explode(ts) AS term FROM (SELECT query_id, rl_tokens(text) AS ts FROM rl_queries)) GROUP BY query_id, term),
        w AS (SELECT {FEW_TERMS} q.query_id, q.term, q.qtf * i.idf AS weight FROM rl_idf() i JOIN q ON q.term = i.term),
        mean AS (SELECT avg(size(rl_tokens(text))) AS avgdl FROM rl_documents)
        SELECT {FEW_TERMS} w.query_id, p.doc_id, sum(w.weight * p.tf * {DEFAULT.bm25_k1 + 1} / (p.tf + {DEFAULT.bm25_k1} * ({1 - DEFAULT.bm25_b} + {DEFAULT.bm25_b} * p.dl / avgdl)))
        FROM rl_postings() p JOIN w ON p.term = w.term CROSS JOIN mean GROUP BY w.query_id, p.doc_id""",
    ),
    # a caller's bound on the rank cuts every task's rows before they are sent
    "rl_ranked()": (
        "query_id BIGINT, doc_id BIGINT, score DOUBLE, rank INT",
        "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e6 + 0.5) DESC, doc_id) FROM rl_bm25()",
    ),
    "rl_duplicates()": ("doc_id BIGINT, first_id BIGINT", "SELECT d.doc_id, f.first_id FROM rl_documents d JOIN (SELECT rl_content_hash(text) AS h, min(doc_id) AS first_id FROM rl_documents GROUP BY 1) f ON rl_content_hash(d.text) = f.h WHERE d.doc_id > f.first_id"),
}


class _Members:
    """Members of a zip archive given as bytes, one row each; an archive that cannot be read gives one row with the reason."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        import io
        import zipfile

        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                for info in archive.infolist():
                    if not info.is_dir():
                        yield info.filename, archive.read(info), None
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
            yield None, None, str(e)


class _Objects(DataSourceReader):
    """Several JSON objects, one after the other in one file, with or without line breaks between."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = [store.get_file_info(at)]
        if found[0].type == fs.FileType.Directory:
            found = [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [InputPartition((self.path, f.path)) for f in sorted(found, key=lambda f: f.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import codecs
        import json

        from pyarrow import fs

        path, at = partition.value
        store = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        with store.open_input_stream(at) as stream:
            rest, decoder, place = "", json.JSONDecoder(), 0
            # a character that the end of a chunk divides waits for the next one
            characters = codecs.getincrementaldecoder("utf-8")("replace")
            while chunk := stream.read(1 << 20):
                rest += characters.decode(chunk)
                while rest := rest.lstrip(" \t\r\n,"):
                    try:
                        _, end = decoder.raw_decode(rest)
                    except ValueError:
                        break
                    yield at, place, rest[:end]
                    rest, place = rest[end:], place + 1
            if rest.strip():
                yield at, place, rest


class ObjectSource(DataSource):
    """Format ``rankloom_objects``: (file, place, object) of concatenated JSON; files are read in tasks of their own."""

    @classmethod
    def name(cls) -> str:
        return "rankloom_objects"

    def schema(self) -> str:
        return "file string, place long, object string"

    def reader(self, schema) -> DataSourceReader:
        return _Objects(self.options)


def tables(spark: SparkSession, documents: DataFrame, queries: DataFrame) -> None:
    """The views (doc_id, text) and (query_id, text) that the table functions read."""
    documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").createOrReplaceTempView("rl_documents")
    queries.selectExpr("CAST(query_id AS BIGINT) AS query_id", "text").createOrReplaceTempView("rl_queries")
    few = is_small(query_terms(spark.table("rl_queries")))
    for head, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body if few else body.replace(FEW_TERMS, '')}")


def register(spark: SparkSession) -> None:
    """Make all functions and the data source known; the table functions over documents need ``tables`` too."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("rl_members", udtf(_Members, returnType="name string, content binary, reason string"))
    spark.dataSource.register(ObjectSource)
