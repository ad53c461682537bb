"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one looks at each block
alone: its length, its share of linked characters, its share of stop words, and
where it stands.  Enough stop words make a long block good, inside an article a
shorter one with fewer of them too; many links make a block outside articles bad;
what is short, or has few stop words, stays open inside an article, and outside
where it has some.  Inside an article links count against the neighbours: a block
full of links (but for long prose that is not all links) beside another one is a
list of links and bad, a lone one is open.
Menus, forms and the like are bad by their element or by names that say so
(``STRONG``).  Names that an article may have parts of (``WEAK``) are one vote
only, which a long, unlinked block of an article with many stop words overrules;
a name counts as a whole, so ``ad-hoc-report`` is no advert (``_hint``).

Pass two gives an open block the label of its nearest decided neighbours within
the same region (the article, or the rest of the page): inside an article one good
neighbour is enough, and its edges count as good; elsewhere the nearer one
decides, the edges of the page being bad.  Where nothing on a page is good, as
when it has no article and is in a language without listed stop words, its long
unlinked blocks are.

So an article of junk, tables or another language, where no block has stop words,
is kept as a whole, and what stands between two lists of links is not.

Defined results: a null or empty page, or one with no main text, gives an empty
text; markup that is cut off or unbalanced never fails; whole pages are read,
whatever their length, in time proportional to it; of two neighbours as near the
bad one wins; repeated rows have equal results; an empty table gives an empty
result; extra columns are kept, but for those that have the names of the new ones.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import bound_batches, pick, table

# Frequent function words of the four languages served.
STOP_WORDS = frozenset(
    """a about all an and are as at be been but by can for from had has have he her his i if in into is it its more not
    of on one or our she so than that the their them there they this to was we were which who will with would you
    au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui
    que sa se ses son sur un une vous
    als am auch auf aus bei das dass dem den der die durch ein eine einem einen einer er es für hat ich ihr im ist mit
    nach nicht noch nur oder sich sie sind über um und uns unter vom von vor war wie wir wird zu zum zur
    al algo como con cual del desde el ella entre era ese esta este ha hay lo los las más mi muy o para pero por porque
    ser si sin sobre son su sus también te tiene todo una uno y ya""".split()
)
#: Elements whose content is no text of the page.
SILENT = "script|style|noscript|template|textarea|title|svg|math|iframe|object|canvas|select|button|audio|video|head"
#: Elements that hold no main text, outside an article or anywhere.
AROUND, ASIDE = frozenset({"header"}), frozenset({"nav", "footer", "aside", "form", "menu", "dialog"})
MAIN = frozenset({"article", "main"})
HOLDERS = AROUND | ASIDE | MAIN | frozenset("div section ul ol dl table figure fieldset details body center td".split())
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th thead tbody tfoot caption figcaption blockquote pre address hr br html summary legend option".split())
#: Names (class, id or role) of holders of something else: decisive ones, and ones that long prose of an article overrules.
STRONG = frozenset(
    """cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments
    commentlist disqus reply replies respond related recommended newsletter subscribe subscription signup login popup modal
    pager pagination complementary contentinfo""".split()
)
WEAK = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion notice notices alert
    disclaimer header masthead share sharing social overlay toolbar widget copyright search""".split()
)
#: Words that may stand beside those in one name and change nothing: cookie-banner-box, site-footer, ad_slot_2.
PLAIN = frozenset(
    """site page main top bottom left right box boxes bar block blocks list lists section sections area areas container wrapper
    wrap inner outer content links link buttons button icons form message messages slot slots unit units post posts article
    articles stories primary secondary global text title label labels thread policy js the user users reader readers small
    large sticky inline body holder region panel panels column columns col row group item items card cards grid feed wp info
    warning banners widgets line note notes zone space spot placeholder leaderboard rectangle mobile desktop wide strip close
    accept dismiss us follow popular latest recent trending tag tags meta media email input field""".split()
)
MANY_LINKS, ALL_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.34, 0.75, 70, 200, 0.10, 0.30

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<silent>{SILENT})\b[^>]*>.*?(?:</(?P=silent)\s*>|(?=<body\b)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT, _CAMEL = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])"), re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    text: str
    region: int  # 0 outside articles, else the number of the article
    placed_bad: bool
    linked: int
    hinted: bool = False  # a weak name stands over it


def _hint(attrs: str, in_main: bool) -> int:
    """2 where a name in the attributes is decisive, 1 where it is a vote, else 0.

    A name is a whole class, id or role; it counts if one of its words is listed and the others are listed or plain.
    """
    if not attrs:
        return 0
    if _HIDDEN.search(attrs):
        return 2
    most = 0
    for m in _NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w and not w[0].isdigit()}
            found = words & (STRONG | WEAK)
            if not found or found == {"header"} and in_main or not words <= STRONG | WEAK | PLAIN:
                continue
            most = max(most, 2 if found & STRONG else 1)
    return most


def cut_blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, white space squeezed and character references decoded."""
    blocks: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open holders, and whether each is the start of a bad (2) or doubtful (1) place
    bad = doubtful = mains = in_main = links = linked = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, mains if in_main else 0, bad > 0, min(linked, len(text)), doubtful > 0))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal bad, doubtful, in_main
        name, level = stack.pop()
        bad -= level == 2
        doubtful -= level == 1
        in_main -= name in MAIN

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        end = m["end"] or m["end2"]
        if tag == "a":
            links = 0 if end else 1
        elif tag in BLOCKS:
            close_block()
            links = 0
            if tag not in HOLDERS:
                continue
            if end:
                if any(name == tag for name, _ in stack):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag in MAIN and not in_main:  # what was left open before the main part ends here
                while any(b for _, b in stack):
                    pop()
                mains += 1
            level = 2 if tag in ASIDE or tag in AROUND and not in_main else 0 if tag == "body" else _hint(attrs, bool(in_main) or tag in MAIN)
            stack.append((tag, level))
            bad += level == 2
            doubtful += level == 1
            in_main += tag in MAIN
    close_block()
    return blocks


def _stops(b: Block) -> float:
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def first_pass(b: Block, beside_links: bool = True) -> str:
    """good, bad or open, from the block alone, and whether a block full of links is its neighbour."""
    if b.placed_bad:
        return "bad"
    stops, short = _stops(b), len(b.text) < SHORT
    if b.hinted and not (b.region and not b.linked and len(b.text) >= 2 * LONG and stops >= MANY_STOPS):
        return "bad"
    if full_of_links(b):
        if b.region and not short and stops >= FEW_STOPS and b.linked <= ALL_LINKS * len(b.text):
            return "good"
        return "bad" if beside_links or not b.region else "open"
    if short:
        return "open" if not b.linked or b.region else "bad"
    if stops >= MANY_STOPS and len(b.text) > LONG or b.region and stops >= FEW_STOPS:
        return "good"
    return "open" if b.region or stops >= FEW_STOPS else "bad"


def full_of_links(b: Block) -> bool:
    return b.linked > MANY_LINKS * len(b.text)


def first_labels(blocks: list[Block]) -> list[str]:
    """``first_pass`` of every block; the blocks before and after it, of its region, tell whether it is in a list of links."""
    full = [full_of_links(b) for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        beside = any(0 <= k < len(blocks) and full[k] and blocks[k].region == b.region for k in (i - 1, i + 1))
        out.append(first_pass(b, beside))
    return out


def second_pass(blocks: list[Block], labels: list[str]) -> list[str]:
    """Labels with every open block decided by its nearest decided neighbours of its region."""
    n = len(blocks)
    if "good" not in labels and not any(b.region for b in blocks):  # nothing speaks for any block: its length must
        labels = ["good" if not (b.placed_bad or b.hinted or b.linked) and len(b.text) >= SHORT else x for b, x in zip(blocks, labels, strict=True)]
    before: list[tuple[int, str] | None] = [None] * n
    after: list[tuple[int, str] | None] = [None] * n
    for found, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, str]] = {}
        for i in order:
            region = blocks[i].region
            found[i] = last.get(region)
            if labels[i] != "open" and not (blocks[i].placed_bad or blocks[i].hinted):
                last[region] = (i, labels[i])
    out = []
    for i, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        if label == "open":
            near = [x for x in (before[i], after[i]) if x]
            if b.region:
                label = "bad" if len(near) == 2 and not any(x[1] == "good" for x in near) else "good"
            elif near:  # the edges of the page count as bad neighbours, and of two as near the bad one wins
                label = min((before[i] or (-1, "bad"), after[i] or (n, "bad")), key=lambda x: (abs(i - x[0]), x[1]))[1]
            else:
                label = "good" if len(b.text) >= SHORT else "bad"
        out.append(label)
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """(main text, blocks, blocks kept) of a page."""
    if not page:
        return "", 0, 0
    blocks = cut_blocks(page)
    labels = second_pass(blocks, first_labels(blocks))
    kept = [b.text for b, label in zip(blocks, labels, strict=True) if label == "good"]
    return " ".join(kept), len(blocks), len(kept)


def extract_main_text(df: DataFrame, page: str = "html") -> DataFrame:
    """``df`` with the column ``page`` replaced by text, n_blocks and n_kept."""
    new = ("text", "n_blocks", "n_kept")
    kept = [f for f in df.schema.fields if f.name != page and f.name not in new]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [main_text(p) for p in x[page]]
            out = x[[f.name for f in kept]].copy()
            for i, name in enumerate(new):
                out[name] = [row[i] for row in found]
            yield out

    return df.mapInPandas(run, schema)


def op2_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    bound_batches(spark)
    found = extract_main_text(pick(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")


QUERIES = {"op2_html_main": op2_html_main}
ORACLE_SQL: dict[str, str] = {}
