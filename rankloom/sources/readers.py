"""Readers of raw files: format sniffing, text, LaTeX, HTML, office archives, label JSON, logs, tables.

Files come through Spark's ``binaryFile`` source, so any store that Spark reads
will do, and formats are told apart by their bytes in Catalyst expressions.
What has no pure form (zip members, office archives) runs in ``mapInPandas``;
PDF, OCR and legacy office formats are plug-in functions, null with a reason when
there is none.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import DEFAULT
from rankloom.surface import ObjectSource

# Formats by extension.
EXTENSIONS = {
    "txt": "text", "md": "text", "csv": "text", "tex": "latex", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "doc": "doc", "rtf": "rtf",
    "odt": "odt", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "zip": "zip",
}
ARCHIVES = ["zip", "tar", "gz", "tgz", "bz2", "7z", "rar", "xz"]


def sniff(content: Column, path: Column) -> Column:
    """Format by extension ``tex``, by magic bytes, by markup at the start, else by extension, else unknown."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.lower(F.make_valid_utf8(F.substring(content, 1, 512).cast("string")))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.try_element_at(F.create_map(*[F.lit(v) for kv in EXTENSIONS.items() for v in kv]), ext)
    return (
        F.when(ext == "tex", "latex").when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), F.when(known.isin("docx", "odt"), known).otherwise("zip"))
        .when(head.startswith("D0CF11E0"), "doc").when(head.startswith("7B5C727466"), "rtf")
        .when(head.startswith("89504E47") | head.startswith("FFD8FF") | head.startswith("49492A00") | head.startswith("4D4D002A"), "image")
        .when(start.rlike(r"^\s*(<!doctype html|<html)"), "html").when(start.rlike(r"\\documentclass|\\begin\{document\}"), "latex")
        .otherwise(F.coalesce(known, F.lit("unknown")))
    )


def strip_latex(t: Column) -> Column:
    """LaTeX source to text: comments, preamble, formatting commands, links, environments, braces."""
    for pattern, by in (
        (r"(?m)(^|[^\\])%.*$", "$1"), (r"(?s)^.*?\\begin\{document\}", ""), (r"(?s)\\end\{document\}.*$", ""), (r"\\href\{[^}]*\}\{([^}]*)\}", "$1"),
        (r"\\(?:textbf|textit|emph|underline|texttt|textsc|section|subsection|subsubsection|paragraph|title|author)\*?\{([^}]*)\}", "$1"),
        (r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", " "), (r"\\item\b", "- "), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " "), (r"[{}]", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t)


# The character references handled in expressions.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def strip_html(t: Column, around: bool = True) -> Column:
    """HTML to text: silent elements (and menus and footers, if ``around``), comments and tags go, white space is squeezed."""
    names = ["script", "style", *(["nav", "footer"] if around else [])]
    for n in names:
        t = F.regexp_replace(t, rf"(?is)<{n}[^>]*>.*?</{n}>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for e, c in ENTITIES.items():
        t = F.replace(t, F.lit(e), F.lit(c))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def squeeze(t: Column) -> Column:
    """At most one empty line in a row, trimmed."""
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def members(files: DataFrame, most_bytes: int | None = 50_000_000) -> DataFrame:
    """path, content, reason of the members of zip files (path ends in archive!member).

    Members over ``most_bytes`` (None: no bound) and archives that cannot be read give a row without content and with a
    reason; nothing is left out or cut.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = lambda path, content, reason: pd.DataFrame({"path": [path], "content": [content], "reason": [reason]}, dtype=object)
        for x in batches:
            for path, content in zip(x["path"], x["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, TypeError) as e:
                    yield row(path, None, f"{type(e).__name__}: {e}")
                    continue
                for m in archive.infolist():
                    name = f"{path}!{m.filename}"
                    if m.is_dir():
                        continue
                    if most_bytes is not None and m.file_size > most_bytes:
                        yield row(name, None, f"member of {m.file_size} bytes, more than {most_bytes}")
                        continue
                    try:
                        body, reason = archive.read(m), None
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error) as e:  # damaged, locked, or packed in another way
                        body, reason = None, f"{type(e).__name__}: {e}"
                    yield row(name, body, reason)

    return files.select("path", "content").mapInPandas(run, "path string, content binary, reason string")


def docx_text(content: bytes) -> str:
    """Paragraphs of an office document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    import html

    lines = [html.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S)]
    return "\n".join(x for x in lines if x.strip())


def odt_text(content: bytes) -> str:
    """Headings and paragraphs of an open document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("content.xml").decode("utf-8")
    import html

    blocks = re.findall(r"<text:(?:p|h)(?: [^>]*)?(?<!/)>(.*?)</text:(?:p|h)>", xml, re.S)
    lines = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<text:(?:s|tab|line-break)\b[^>]*/>", " ", b))) for b in blocks]
    return "\n".join(x for x in lines if x.strip())


#: One step through rich text: a brace, an escaped byte, a control word with its number, another control sign, or plain text.
_RTF = re.compile(r"(?P<brace>[{}])|\\'(?P<byte>[0-9a-fA-F]{2})|\\(?P<word>[a-zA-Z]+)(?P<number>-?\d+)? ?|\\(?P<sign>[^a-zA-Z])|(?P<plain>[^{}\\]+)")
#: Groups that hold no text of the document, and control words that stand for characters.
_RTF_ASIDE = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "listtable", "listoverridetable", "themedata", "object"}
_RTF_CHARS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(content: bytes) -> str:
    """The text of a rich-text file; its bytes are read as the western code page that they default to."""
    out, aside, stack, skip, width = [], False, [], 0, 1
    for m in _RTF.finditer(content.decode("cp1252", "replace")):
        kind, said = m.lastgroup, m.group()
        if m["brace"]:
            if said == "{":
                stack.append((aside, width))
            elif stack:
                aside, width = stack.pop()
            skip = 0
            continue
        word = m["word"]
        if m["sign"] == "*" or word in _RTF_ASIDE:
            aside = True
        elif word == "uc":
            width = int(m["number"] or 1)
        elif aside or word and word != "u" and word not in _RTF_CHARS:
            pass
        elif word == "u":
            out.append(chr(int(m["number"] or 0) % 65_536))
            skip = width  # so many characters follow for readers without Unicode
        elif word:
            out.append(_RTF_CHARS[word])
        elif kind == "byte" or kind == "sign":
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(m["byte"], 16)]).decode("cp1252", "replace") if m["byte"] else {"~": "\u00a0", "_": "-", "\n": "\n"}.get(said[1], said[1] if said[1] in "{}\\" else ""))
        else:
            plain = re.sub(r"[\r\n]", "", said)
            out.append(plain[skip:])
            skip = max(0, skip - len(plain))
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _plugged(df: DataFrame, plugins: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """Adds plugged text and a reason for formats without an expression."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            texts, reasons = [], []
            for fmt, content in zip(x["format"], x["content"], strict=True):
                try:
                    texts.append(plugins[fmt](content) if fmt in plugins else None)
                    reasons.append(None if fmt in plugins else f"no extractor for {fmt}")
                except Exception as e:  # a broken file is reported, the job goes on
                    texts.append(None)
                    reasons.append(f"{type(e).__name__}: {e}")
            yield x[["path", "format"]].assign(text=texts, reason=reasons)

    return df.select("path", "format", "content").mapInPandas(run, "path string, format string, text string, reason string")


def extract_text(files: DataFrame, plugins: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, format, text, reason for binary files (path, content)."""
    found = files.select("path", "content").withColumn("format", sniff(F.col("content"), F.col("path")))
    plain = ["text", "latex", "html"]
    raw = F.make_valid_utf8(F.col("content").cast("string"))  # what is no UTF-8 is replaced
    own = found.where(F.col("format").isin(plain)).select(
        "path", "format", squeeze(F.when(F.col("format") == "latex", strip_latex(raw)).when(F.col("format") == "html", strip_html(raw)).otherwise(raw)).alias("text"), F.lit(None).cast("string").alias("reason"),
    )
    return own.union(_plugged(found.where(~F.col("format").isin(plain)), {"docx": docx_text, "odt": odt_text, "rtf": rtf_text} | (plugins or {})))


def read_directory(spark: SparkSession, path: str, recursive: bool = False, min_chars: int = DEFAULT.min_chars, plugins=None, most_bytes: int | None = 50_000_000, refused: bool = False) -> DataFrame:
    """doc_id (file stem; parent_stem where stems clash), path, format, text, reason of files with enough text, those in zip files too.

    Hidden files, other archives and archives in archives are skipped.  With ``refused`` what could not be read stays, as a
    row without text that says why: members over ``most_bytes`` (None: no bound), damaged or locked archives, formats
    without a reader, files with less than ``min_chars`` characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/!]+)$", 1)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    shown = ~name.rlike(r"^(\.|__)") & ~F.col("path").contains("!__MACOSX/")
    inside = members(files.where(shown & (ext == "zip")), most_bytes)
    lost = inside.where(F.col("content").isNull() & shown).select("path", F.lit("archive").alias("format"), F.lit(None).cast("string").alias("text"), "reason")
    inside = inside.where(F.col("content").isNotNull())
    files = files.select("path", "content").where(~ext.isin(ARCHIVES)).union(inside.select("path", "content").where(~ext.isin(ARCHIVES)))
    found = extract_text(files.where(shown), plugins)
    enough = F.length(F.trim("text")) > min_chars
    if refused:
        reason = F.coalesce("reason", F.when(~F.coalesce(enough, F.lit(False)), F.lit(f"no more than {min_chars} characters")))
        found = found.select("path", "format", F.when(enough, F.col("text")).alias("text"), reason.alias("reason")).union(lost)
    else:
        found = found.where(enough)
    return with_stems(found)


def with_stems(found: DataFrame) -> DataFrame:
    """Adds doc_id from the path."""
    stem = F.regexp_extract("path", r"([^/!]+?)(\.[A-Za-z0-9]+)?$", 1)
    parent = F.regexp_extract("path", r"([^/!]+)[/!][^/!]+$", 1)
    clash = found.select(stem.alias("_stem")).groupBy("_stem").agg(F.count("*").alias("_n"))
    keyed = found.withColumn("_stem", stem).join(clash, "_stem")
    return keyed.withColumn("doc_id", F.when(F.col("_n") > 1, F.concat_ws("_", parent, "_stem")).otherwise(F.col("_stem"))).drop("_stem", "_n")


def display_name(doc_id: Column) -> Column:
    return F.initcap(F.translate(doc_id, "_-", "  "))


def parse_labels(raw: str) -> dict[str, dict[str, float]]:
    """Concatenated JSON objects {query: {document: grade}}, commas between them allowed; later ones win, what is broken ends it."""
    decoder, at, out = json.JSONDecoder(), 0, {}
    while at < len(raw):
        while at < len(raw) and raw[at] in " \t\r\n,":
            at += 1
        try:
            found, at = decoder.raw_decode(raw, at)
        except ValueError:
            break
        if isinstance(found, dict):
            for query, grades in found.items():
                out.setdefault(query, {}).update({k: float(v) for k, v in grades.items() if isinstance(v, int | float)})
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade of label files, each of one or several JSON objects {query: {document: grade}}.

    Files are read and taken apart by tasks; of a pair that is graded again the last place in its file counts.
    """
    spark.dataSource.register(ObjectSource)
    objects = spark.read.format("rankloom_objects").load(path)
    graded = objects.select("file", "place", F.explode(F.from_json("object", "map<string,map<string,string>>")).alias("query_id", "grades"))
    each = graded.select("file", "place", "query_id", F.explode("grades").alias("doc_id", "said"))
    grades = each.select("file", "place", "query_id", "doc_id", F.col("said").try_cast("double").alias("grade")).where("grade IS NOT NULL")
    return grades.groupBy("query_id", "doc_id").agg(F.max_by("grade", F.struct("file", "place")).alias("grade"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, broken ones give nulls."""
    return spark.read.schema(schema).json(path)


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, partitions: int | None = None, fetch: int = 10_000, **options) -> DataFrame:
    """A relational table over JDBC, read by ``partitions`` connections that each take a range of the numeric ``key``.

    The range is asked of the database first (one row).  Columns and filters that a plan puts on the result are pushed into
    each connection's statement; rows without a key come with the first range.  Without a key one connection reads all.
    """
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch).options(**options)
    if key is None:
        return reader.option("dbtable", name).load()
    ends = reader.option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {name}").load().first()
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch).options(**options).option("dbtable", name)
    if ends[0] is None:
        return reader.load()
    n = partitions or spark.sparkContext.defaultParallelism
    return reader.option("partitionColumn", key).option("lowerBound", str(ends[0])).option("upperBound", str(ends[1] + 1)).option("numPartitions", n).load()


def best_labelled_query(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, n: the query with most labels on the corpus; ties by id."""
    return labels.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query_id").limit(1)


def check_upload(query_text: str, n_files: int, config=DEFAULT) -> list[str]:
    """Reasons to refuse an upload; none means it may start."""
    out = []
    if not (query_text or "").strip():
        out.append("the query text is empty")
    if len(query_text or "") > config.max_query_chars:
        out.append(f"the query text has more than {config.max_query_chars} characters")
    if config.max_files is not None and n_files > config.max_files:
        out.append(f"more than {config.max_files} files")
    return out


def repair_json(raw: str) -> dict | list | None:
    """JSON out of fences, closing what a cut left open; None where that fails."""
    body = re.sub(r"^\s*```(?:json)?|```\s*$", "", raw or "").strip()
    try:
        return json.loads(body)
    except ValueError:
        pass
    open_, quoted, escaped = [], False, False
    for c in body:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
    closed = body + '"' * quoted
    for cut in (closed, re.sub(r",\s*$", "", closed), re.sub(r",?\s*\"[^\"]*\"?\s*:?\s*$", "", closed)):
        try:
            return json.loads(cut + "".join(reversed(open_)))
        except ValueError:
            continue
    return None


def parse_json_column(c: Column, schema: str) -> Column:
    """A struct from JSON text with or without fences; null where it is broken."""
    body = F.regexp_replace(F.regexp_replace(c, r"^\s*```(?:json)?", ""), r"```\s*$", "")
    return F.from_json(body, schema)
