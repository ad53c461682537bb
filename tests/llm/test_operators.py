"""The training-data operators against brute force on small fixtures, with nulls, empties, ties, repeats and extra columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import decontamination, html_main, media, near_dup, packing, quality, repeats, resharding, shingles, suffix_array, toxicity, url_reputation

DOCS = "doc_id long, text string, lang string, score double, label int, bands string, spans string, media string, _key string"
rng = np.random.default_rng(5)
WORDS = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 0.5, 1, "b", "s", "m", "k") for i, t in rows], DOCS)


LONG = prose(30_000, 99)
CASES = [(0, None), (1, ""), (2, "   \n"), (3, "one"), (4, "one"), (None, prose(30, 1)), (6, LONG), (7, "é" * 300 + prose(100, 3)), (7, "é" * 300 + prose(100, 3))]


# ------------------------------------------------------------------ near-duplicates


def components_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        if i is not None:
            sets[i] = s
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies():
    base = prose(120, 7).split()
    rows = list(CASES)
    for k in range(60):  # a large group of near copies, mostly linked through the original only
        w = list(base)
        for p in np.random.default_rng(k).choice(120, 2, replace=False):
            w[p] = f"x{k}"
        rows.append((100 + k, " ".join(w)))
    rows.append((200, " ".join(base)))
    rows += [(300 + k, prose(80, 11).upper() if k % 2 else prose(80, 11)) for k in range(20)]
    passage = prose(60, 21)
    rows += [(400 + k, f"{passage} {prose(40, 500 + k)}") for k in range(40)]  # much in common, yet below the threshold
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = near_copies()
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    expected = components_by_brute_force(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None) and not any(r.kept for r in got if r.doc_id is None)


def test_near_duplicates_blocks_alone(spark, monkeypatch):
    """What the pivots would find, blocks of unlike labels find too."""
    monkeypatch.setattr(near_dup, "PIVOTS", 0)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "ONE_TASK_EDGES", 0)
    rows = near_copies()
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == components_by_brute_force(rows)


def test_near_duplicates_all_pivots(spark, monkeypatch):
    """A bucket whose members were all pivots in the first round is still compared: 2 and 3 meet in bucket 1 only, under pivot 1."""
    monkeypatch.setattr(near_dup, "SMALL", 1)
    bands = {1: [1, 4], 2: [1, 2], 3: [1, 3], 4: [2], 5: [3], 6: [4]}
    alike, other = prose(120, 7).split(), prose(120, 8).split()
    rows = [(i, " ".join([*(other if i in (1, 6) else alike), f"x{i}"])) for i in bands]
    placed = spark.createDataFrame([(i, 117, bytes([i]), b) for i, b in bands.items()], "doc_id long, n_shingles long, set_key binary, bands array<long>")
    monkeypatch.setattr(near_dup, "sketched", lambda *_: placed)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {1: 1, 6: 1, 2: 2, 3: 2, 4: 2, 5: 2}


def test_near_duplicates_of_the_tables(spark):
    """All pairs of the small table's documents, exactly."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets, holders = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    both = Counter(p for ids in holders.values() if len(ids) > 1 for p in itertools.combinations(sorted(ids), 2))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.op3_near_dup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_empty(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for n, share in ((3, 1.0), (40, 0.5), (2000, 0.75), (300, 0.1)):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * share)], r.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)])
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        x, y = shingles.fast_similarity_sketch([a, b], 1024)
        assert abs((x == y).mean() - true) < 0.08
        assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


# ------------------------------------------------------------------ repeated passages


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=0, max_size=200), st.integers(1, 12), st.integers(1, 4))
def test_repeated_starts(raw, least, symbols):
    s = (np.frombuffer(raw, np.uint8) % symbols + 97).astype(np.uint8)
    b = s.tobytes()
    seen = Counter(b[i : i + least] for i in range(len(b) - least + 1))
    expected = [i + least <= len(b) and seen[b[i : i + least]] > 1 for i in range(len(b))]
    assert suffix_array.repeated_starts(s, least).tolist() == expected


def removed_by_brute_force(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + least] for r in raws for k in range(len(r) - least + 1))
    out = []
    for r in raws:
        m = np.zeros(len(r), bool)
        for k in range(len(r) - least + 1):
            if seen[r[k : k + least]] > 1:
                m[k : k + least] = True
        out.append((len(r), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int), [0]])) == 1).sum()), bytes(np.frombuffer(r, np.uint8)[~m])))
    return out


def repeat_texts():
    passage = prose(90, 31)
    texts = [t for _, t in CASES if t is not LONG] + [prose(2_000, 98)]
    texts += [f"{prose(30, 600 + k)} {passage} {prose(30, 700 + k)}" for k in range(30)]
    texts += ["abc " * 300, "line of text\n" * 90, prose(100, 41) + " ü " + prose(100, 42), "ü" + prose(100, 42)]
    return texts


@pytest.mark.parametrize("cuts", [2048, 3])
def test_repeats(spark, monkeypatch, cuts):
    monkeypatch.setattr(repeats, "CUTS", cuts)  # 3: nearly all goes the way of what does not fit a shard
    texts = repeat_texts()
    docs = frame(spark, [(i if i != 3 else None, t) for i, t in enumerate(texts)])
    spans = repeats.repeated_spans(docs)
    by_key = {bytes(r.text_key): r.spans for r in spans.collect()}
    for t, (n, removed, n_spans, kept) in zip(texts, removed_by_brute_force(texts, 400), strict=True):
        raw = (t or "").encode()
        found = by_key.get(hashlib.sha256(raw).digest()[:16], [])
        assert (len(raw), sum(s.b - s.a for s in found), len(found)) == (n, removed, n_spans)
        assert repeats.kept_bytes(raw, [s.asDict() for s in found]) == kept


def test_repeats_of_the_tables(spark):
    """Every byte of the small table's documents."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    seen = Counter(hash(t[k : k + 400]) for _, t in rows for k in range(len(t) - 399))
    expected = {}
    for i, t in rows:
        m = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                m[k : k + 400] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~m[:-1]])
        expected[i] = (len(t), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = repeats.op4_repeats(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == expected
    assert all(abs(len(r.text.encode()) - (r.n_bytes - r.n_removed)) <= 6 * r.n_spans for r in got)


def test_cut_repeats_keeps_rows_and_characters(spark):
    texts = repeat_texts()
    docs = frame(spark, list(enumerate(texts)))
    out = repeats.cut_repeats(docs).collect()
    assert len(out) == len(texts) and out[0].asDict().keys() == set(docs.columns)
    for r, (_, _, _, kept) in zip(sorted(out, key=lambda r: r.doc_id), removed_by_brute_force(texts, 400), strict=True):
        assert "�" not in (r.text or "") and abs(len((r.text or "").encode()) - len(kept)) < 8
    assert repeats.cut_repeats(frame(spark, [])).count() == 0
    inner = docs.withColumnRenamed("spans", "_spans")  # names that the operator uses inside
    assert {tuple(r[c] for c in ("doc_id", "_key", "_spans")) for r in repeats.cut_repeats(inner).collect()} == {(i, "k", "s") for i in range(len(texts))}


def test_cut_repeats_by_words(spark):
    """Passages of fifty words go, whatever their bytes above ``least``; shorter ones stay."""
    long, short = prose(51, 131), prose(45, 132)
    rows = [(k, f"{prose(30, 800 + k)} {(long, short)[k % 2]} {prose(30, 900 + k)}") for k in range(8)]
    got = {r.doc_id: r.text for r in repeats.cut_repeats(frame(spark, rows), 200, 50).collect()}
    for k, t in rows:
        assert got[k] == t if k % 2 else (long not in got[k] and 59 <= len(got[k].split()) <= 60)


# ------------------------------------------------------------------ decontamination


def test_leaks(spark):
    item = "A train leaves Boston at 9 am and travels 60 miles per hour towards Berlin with 120 people on board"
    other = "A train leaves London at 7 am and travels 45 miles per hour towards Madrid with 80 people on board"
    broken = "A train leaves Boston at 9 am and travels 60 miles per hour towards Berlin with 120 people on board, then a train leaves Paris at 3 am and travels 61 miles per hour towards Berlin"
    items = spark.createDataFrame([(1, item, "x"), (2, "tiny bit", "x"), (3, None, "x"), (4, "9 10 11", "x"), (5, item, "x"), (None, item, "x")], "item_id int, text string, doc_id string")
    rows = [*CASES, (20, f"intro. {item} outro"), (21, f"Well, {other}."), (22, prose(300, 4)), (23, "a Tiny bit more"), (24, broken), (25, f"x {item}"), (25, f"x {item}")]
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(frame(spark, rows), items).collect()}
    assert {k for k in got if k[0] in (20, 21, 25)} == {(d, i) for d in (20, 21, 25) for i in (1, 5)}
    assert (23, 2) in got and not any(d == 22 or d < 10 for d, _ in got) and not any(i == 4 for _, i in got)
    assert (24, 1) in got  # it holds the item word for word; the variant behind it takes nothing away
    assert got[21, 1].n_slots >= 4


def test_leaks_by_occurrence(spark):
    """A second occurrence, a stray window or two equal values take no leak away."""
    text = "A tank holds {} litres of clean water and {} pumps empty it within {} hours while a boy named {} watches them from the old bridge"
    item = text.format(300, 3, 5, "Peter")
    one, two = text.format(410, 7, 9, "Walter"), text.format(520, 8, 6, "Robert")
    stray = "Elsewhere a tank holds 77 litres of clean water and 66 pumps"
    longer = one.replace("within", "quite fully, as all had hoped, within")
    docs = {
        1: item, 2: one, 3: f"{item}. {one}", 4: f"{prose(90, 1)}. {one}. {prose(90, 2)}. {two}", 5: f"{one}. {prose(200, 3)}. {stray}", 6: f"{item} {prose(200, 4)} {stray}",
        7: text.format(300, 4, 4, "Peter"), 8: f"{longer}. {prose(300, 5)}. {stray}", 9: stray, 10: f"{prose(50, 6)}. {stray}. {prose(50, 7)}",
    }
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = {r.doc_id: r for r in decontamination.find_leaks(frame(spark, list(docs.items())), items).collect()}
    assert set(got) == set(range(1, 9))
    assert all(r.n_hit <= r.n_windows and r.n_slots >= 3 for r in got.values())
    twice = "A cook took 3 red apples and then laid 3 small cakes on the table so 3 guests of the house had 3 figs at noon"
    items = spark.createDataFrame([(1, twice)], "item_id int, text string")
    mixed = twice.replace("3 red", "4 red").replace("3 small", "6 small").replace("3 guests", "5 guests")
    assert decontamination.find_leaks(frame(spark, [(1, mixed)]), items).count() == 0  # one occurrence that contradicts itself


def test_leaks_edited_and_quoted(spark):
    """One edited word of a short item, and thirteen words in a row of a long one."""
    short, long = prose(20, 60).split(), prose(37, 61).split()
    items = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id int, text string")
    around = lambda k, words: f"{prose(40, k)} {' '.join(words)} {prose(40, k + 1)}"
    docs = {1: around(70, [*short[:9], "zz", *short[10:]]), 2: around(72, long[12:25]), 3: around(74, long[12:24]), 4: around(76, short[:9])}
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, list(docs.items())), items).collect()}
    assert got == {(1, 1), (2, 2)}  # twelve in a row of 37, or nine of 20, are neither
    assert decontamination.find_leaks(frame(spark, [(5, f"{' '.join(long[:9])} {prose(30, 78)} {' '.join(long[20:29])}")]), items).count() == 0


def test_leaks_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    items = spark.createDataFrame([(1, prose(40, 50))], "item_id int, text string")
    assert [r.doc_id for r in decontamination.find_leaks(frame(spark, [(1, prose(40, 50)), (2, prose(40, 51))]), items).collect()] == [1]
    assert decontamination.find_leaks(frame(spark, []), items).count() == 0
    assert decontamination.find_leaks(frame(spark, CASES), items.limit(0)).count() == 0


def leaks_by_brute_force(docs, items, window=8, cover=0.5):
    """Every window of every document against every window of every item, sets judged as the docstring says."""
    import regex

    named, cut = regex.compile(r"(?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll})"), regex.compile(decontamination._CUT)
    digit = lambda t: "0" <= t < ":"

    def tokens(text):
        return [t for t in cut.split(named.sub("§", (text or "").replace("§", " ")).lower()) if t]

    def template(raw):
        return ["§p" if t.startswith("§") else "§n" if digit(t) else "§u" if t in decontamination.UNITS and k and digit(raw[k - 1]) else t for k, t in enumerate(raw)]

    def spans(ats, n):
        covered = sorted({k for a in ats for k in range(a, a + n)})
        run = most = 0
        for k, c in enumerate(covered):
            run = run + 1 if k and c == covered[k - 1] + 1 else 1
            most = max(most, run)
        return len(covered), most

    known = {}
    for item, text in items:
        raw = tokens(text)
        if item is None or not raw:
            continue
        for form in (raw, ["§" + raw[0].lstrip("§"), *raw[1:]]):
            kinds, n = template(form), min(window, len(form))
            for k in range(len(form) - n + 1):
                part = kinds[k : k + n]
                if sum(not t.startswith("§") for t in part) >= max(1, -(-n // 2)):
                    known.setdefault(item, {}).setdefault((n, tuple(part)), set()).add((k + 1, tuple(form[k : k + n])))
    found = set()
    for doc, text in docs:
        raw = tokens(text)
        kinds = template(raw)
        for item, windows in known.items() if doc is not None else ():
            n = next(iter(windows))[0]
            n_windows, n_tokens = len({a for w in windows.values() for a, _ in w}), spans({a for w in windows.values() for a, _ in w}, n)[0]
            hits = []
            for k in range(len(raw) - n + 1):
                for at, item_raw in windows.get((n, tuple(kinds[k : k + n])), ()):
                    slots = {(kind, i, d) for kind, i, d in zip(kinds[k : k + n], item_raw, raw[k : k + n], strict=True) if kind.startswith("§")}
                    hits.append((k + 1 - at, at, slots, item_raw == tuple(raw[k : k + n])))

            def leak(group, in_row):
                for chosen in (group, [h for h in group if h[3]]):
                    ats, slots = {h[1] for h in chosen}, set().union(*(h[2] for h in chosen))
                    covered, run = spans(ats, n)
                    enough = len(ats) >= cover * n_windows or covered >= cover * n_tokens or in_row and run >= 13
                    if ats and enough and len(slots) == len({s[:2] for s in slots}):
                        return True
                return False

            aligned = sorted({h[0] for h in hits})
            places, last = {}, None
            for a in aligned:
                places[a] = places[last] if last is not None and a - last <= n_windows else a
                last = a
            groups = [([h for h in hits if h[0] == a], True) for a in aligned]
            groups += [([h for h in hits if places[h[0]] == p], False) for p in set(places.values())] + [(hits, False)]
            if any(leak(g, r) for g, r in groups):
                found.add((doc, item))
    return found


def test_leaks_by_brute_force(spark):
    """All leaks of the small tables, and of edited, re-parameterised and repeated items."""
    path = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    r = np.random.default_rng(12)
    made = "On day {} a farmer named {} sold {} kg of corn to {} shops for {} dollars and kept {} kg at home in town"
    items += [(900, made.format(3, "Peter", 20, 4, 50, 7)), (901, made.format(3, "Peter", 20, 4, 50, 7)), (902, "short one"), (None, "none"), (903, None)]
    for k in range(60):
        words = items[int(r.integers(len(items) - 4))][1].split() if k % 2 else made.format(*(["Peter", "Mary"][int(v)] if j == 1 else int(v) + 2 for j, v in enumerate(r.integers(0, 2, 6)))).split()
        for _ in range(int(r.integers(0, 3))):
            words[int(r.integers(len(words)))] = ["x", "9", "Zed", "and so"][int(r.integers(4))]
        docs.append((5_000 + k, f"{prose(int(r.integers(0, 30)), k)} {' '.join(words)} {prose(9, k + 100)} {' '.join(words[int(r.integers(9)):])}"))
    docs += CASES
    got = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = leaks_by_brute_force(docs, items)
    assert got == expected and len(expected) > 20


# ------------------------------------------------------------------ html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site name and the best of it</p></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use the cookies</p></div>
<article><h1>Head &amp; title</h1><p>First <b>bo</b>ld para&shy;graph of\n the text.<br>Next</p><div class="share"><a href="#">Share</a></div><form><p>Sign up</p></form>
<section id="comments"><p>A reader says so</p></section><p>Last &lt;one&gt;</p></article><aside><p>Related things of the day</p></aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE)[0] == "Head & title First bold para\xadgraph of the text. Next Last <one>"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p>ok</", "<div><div></p></article>", "<script>never closed", "<!-- never closed", "<a href=\"x>y</a><p>z", "</nav></nav>"])
def test_broken_pages(page):
    assert isinstance(html_main.main_text(page)[0], str)


def test_pages_without_article_use_density():
    good = "This is the story of a man who was in the house and of the dog that he had with him when it was late in the day, and so on. " * 3
    page = f"<body><div>Menu Contact Login</div><p>{good}</p><p>Then it ended.</p><p>{good}</p><div><a href=x>more more more</a></div></body>"
    assert html_main.main_text(page)[0] == " ".join(f"{good} Then it ended. {good}".split())


def block(n, seed, stops):
    """A paragraph of which the share ``stops`` are stop words."""
    r = np.random.default_rng(seed)
    return " ".join("the" if r.random() < stops else w for w in r.choice(WORDS, n))


def test_density_decides_inside_articles():
    """Stop words decide a block of an article; what is left open follows its neighbours, not its place alone."""
    label = lambda text, linked=0, region=1: html_main.first_pass(html_main.Block(text, region, False, linked))
    prose_, junk = block(40, 1, 0.3), block(40, 2, 0.0)
    assert label(prose_) == "good" and label(junk) == "open" and label(junk, region=0) == "bad" and label("Short one") == "open"
    assert label(prose_, len(prose_) // 2) == "good" and label(prose_, len(prose_)) == "bad" and label(junk, len(junk) // 2) == "bad"
    links = "<ul><li><a href=x>one two three four</a></li><li><a href=y>five six seven eight</a></li></ul>"
    page = lambda *parts: html_main.main_text(f"<body><article>{''.join(parts)}</article></body>")[0]
    assert page(f"<p>{junk}</p>", links, f"<p>{junk}</p>") == f"{junk} {junk}"
    assert page(f"<p>{prose_}</p>", links, "<p>Read on:</p>", links, f"<p>{junk}</p>", f"<p>{prose_}</p>") == f"{prose_} {junk} {prose_}"


def in_article(*parts):
    return html_main.main_text(f"<body><nav><a href=x>Menu</a></nav><article>{''.join(parts)}</article><footer>Foot</footer></body>")[0]


@pytest.mark.parametrize("name", ['class="ad-hoc-report"', 'class="share-price"', 'id="search-for-meaning"', 'class="adHoc headerless"', 'class="read-ad"'])
def test_names_of_parts_of_articles(name):
    """A paragraph of 90 characters under a name that only holds a listed word stays."""
    text = "The report of the day says that shares of the firm went up and down and then up again."
    assert in_article("<h1>Head</h1>", f"<div {name}><p>{text}</p></div>") == f"Head {text}"


@pytest.mark.parametrize("name", ['class="ad"', 'class="x cookie-notice"', 'id=site_footer', 'class="ad-slot-3"', 'class="adBanner"', 'role="search"', 'class="post-comments"', 'id="comments"', 'hidden', 'class="ad-300x250"', 'class="related-posts"', 'class="alert-info"', 'class="newsletter__email-field"'])
def test_names_of_other_things(name):
    text = "The report of the day says that shares of the firm went up and down and then up again."
    assert in_article("<h1>Head</h1>", f"<div {name}><p>{text}</p></div>", f"<p>{text}</p>") == f"Head {text}"


def test_links_of_articles():
    first, text = "It is the first part of what the man had to say to us and to all of them on that day.", "Then it was over."
    assert in_article(f"<p>{first}</p>", "<p>See <a href=b>part two</a></p>", f"<p>{text}</p>") == f"{first} See part two {text}"
    assert in_article(f"<p>{first}</p>", "<p><a href=b>All of it is one link</a></p>", f"<p>{text}</p>") == f"{first} All of it is one link {text}"
    assert in_article(f"<p>{first}</p>", "<ul><li><a href=b>One</a></li><li><a href=c>Two</a></li></ul>") == first


def test_pages_without_stop_words():
    words = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua"
    assert html_main.main_text(f"<body><div><a href=x>Menu</a></div><p>{words}</p><p>{words}</p><div>Foot</div></body>")[0] == f"{words} {words}"


def test_each_rule_alone():
    """Two blocks that differ in one thing get different labels."""
    of = lambda text, region=0, linked=0, hinted=False, beside=False: html_main.first_pass(html_main.Block(text, region, False, linked, hinted), beside)
    long_, some = block(60, 1, 0.5), block(20, 1, 0.5)
    assert len(long_) > html_main.LONG and html_main.SHORT < len(some) < html_main.LONG
    assert (of(long_), of(some)) == ("good", "open")  # length
    assert (of(long_), of(block(60, 1, 0.15)), of(block(60, 1, 0.0))) == ("good", "open", "bad")  # stop words
    assert (of(long_), of(long_, linked=len(long_) // 2)) == ("good", "bad")  # links
    assert (of("One link", 1, 8), of("One link", 1, 8, beside=True)) == ("open", "bad")  # a list of links
    assert (of(some), of(some, 1)) == ("open", "good")  # place
    prose_ = block(100, 3, 0.5)
    assert (of(some, 1, hinted=True), of(prose_, 1, hinted=True), of(prose_, 0, hinted=True), of(prose_, 1, 9, hinted=True)) == ("bad", "good", "bad", "bad")  # a weak name
    near = lambda *labels: html_main.second_pass([html_main.Block("x", 0, False, 0)] * len(labels), list(labels))
    assert (near("good", "open", "good")[1], near("bad", "open", "good")[1]) == ("good", "bad")  # neighbours


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["good", "bad", "open"]), st.booleans(), st.integers(1, 120)), max_size=14))
def test_second_pass_by_brute_force(made):
    """Every open block against all others, one by one."""
    blocks = [html_main.Block("y" * n, region, placed and label == "bad", 0) for region, label, placed, n in made]
    labels = [label for _, label, _, _ in made]
    if "good" not in labels and not any(b.region for b in blocks):
        labels = ["good" if not b.placed_bad and len(b.text) >= html_main.SHORT else x for b, x in zip(blocks, labels, strict=True)]
    expected = list(labels)
    for i, b in enumerate(blocks):
        if labels[i] != "open":
            continue
        decided = [k for k, c in enumerate(blocks) if c.region == b.region and labels[k] != "open" and not c.placed_bad]
        sides = [[k for k in decided if k < i], [k for k in decided if k > i]]
        nearest = [(i - max(sides[0]), labels[max(sides[0])]) if sides[0] else None, (min(sides[1]) - i, labels[min(sides[1])]) if sides[1] else None]
        if b.region:
            expected[i] = "bad" if all(x and x[1] == "bad" for x in nearest) else "good"
        elif not decided:
            expected[i] = "good" if len(b.text) >= html_main.SHORT else "bad"
        else:
            both = [nearest[0] or (i + 1, "bad"), nearest[1] or (len(blocks) - i, "bad")]
            least = min(d for d, _ in both)
            expected[i] = "bad" if any(x == (least, "bad") for x in both) else "good"
    assert html_main.second_pass(blocks, labels) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("psqjl"), st.integers(0, 10_000)), min_size=1, max_size=12), st.lists(st.integers(0, 9), max_size=6))
def test_main_text_of_made_pages(article, around):
    """Articles of prose, short lines, quotes, junk and linked words between boilerplate come back whole and alone."""
    noise = [
        "<nav><ul><li><a href=a>Home</a><li><a href=b>All about us</a></ul></nav>", "<header><p>The best site of them all is this one</p></header>", "<footer><p>All rights are with us and with you</p></footer>",
        "<aside><h3>Related</h3><p>What to read on the way to work and at home</p></aside>", "<div class='ad'>Buy it now, it is the best of all</div>", "<form><p>Sign up to the letter that we send</p></form>",
        "<script>var the = '<p>of and in</p>';</script>", "<style>p {}</style>", "<div id=comments><p>I think that it is as good as it was in the past</p></div>", "<div class=cookie-notice><p>We use cookies, and that is the way it is</p></div>",
    ]
    made, expected = [], []
    for kind, seed in article:
        text = {"p": block(40, seed, 0.35), "s": f"Line {seed}", "q": block(25, seed, 0.3), "j": block(40, seed, 0.0), "l": block(30, seed, 0.3)}[kind]
        expected.append(text)
        first, rest = text.split(" ", 1)
        made.append({"q": f"<blockquote>{text}</blockquote>", "l": f"<p><a href=z>{first}</a> {rest}</p>"}.get(kind, f"<p>{text}</p>"))
    shown = [noise[k] for k in around]
    half = len(shown) // 2
    page = f"<html><head><title>t</title></head><body>{''.join(shown[:half])}<main><article>{''.join(made)}</article></main>{''.join(shown[half:])}</body></html>"
    assert html_main.main_text(page)[0] == " ".join(expected)


def test_main_text_of_shown_documents():
    """Every page of the small tables shows one document: its heading and text, and nothing else, come back."""
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id")["text"]
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    bare = lambda t: re.sub(r"\s", "", t)
    for url, page in zip(pages["url"], pages["html"], strict=True):
        shown = bare(docs[int(re.search(r"/(\d+)(?:\.html)?/?(?:[?#].*)?$", url)[1])])
        heading = bare(html_main.html.unescape(re.search(r"<h1>(.*?)</h1>", page, re.S)[1]))
        assert bare(html_main.main_text(page)[0]) in (heading + shown, shown)


def test_extract_main_text_frame(spark):
    pages = spark.createDataFrame([(1, None, "u", "old"), (2, PAGE, None, "old"), (None, "<p>" + "x " * 50_000, "u", "old")], "page_id int, html string, url string, text string")
    got = html_main.extract_main_text(pages).collect()
    assert len(got) == 3 and {r.page_id: r.text for r in got}[1] == ""
    assert html_main.extract_main_text(pages.limit(0)).count() == 0


# ------------------------------------------------------------------ models


def labelled(n):
    insults, groups = ["scum", "moron"], ["vequa", "vequeux"]
    rows = []
    for i in range(n):
        words = prose(60, 2_000 + i).split()
        bad = i % 4 == 0
        if bad:
            words[5], words[9] = insults[i // 4 % 2], groups[i // 8 % 2]
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = labelled(400)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, "scum"), (1_000, None), (1_001, ""), (1_002, LONG)])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i < 300] + [(None, 1, 0), (5, None, 0)], "doc_id int, toxic int, text int")
    got = {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()}
    held = [(y, got[i]) for i, _, y in rows if i >= 300]
    assert all((s >= 0.7) == (y == 1) for y, s in held) and all(0 <= s <= 1 for s in got.values()) and got[1_000] == got[1_001] < 0.7


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a")])
    none = spark.createDataFrame([], "doc_id int, toxic int")
    assert toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, none)).first().score < 0.7


def test_machine_learns_pairs():
    """Neither term alone, only both together."""
    r = np.random.default_rng(3)
    rows, y = [], []
    for _ in range(1_200):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array([0] * a + [1] * b + [2 + int(r.integers(6))]))
        y.append(int(a and b))
    m = toxicity.fit_machine(rows, np.array(y), np.arange(8))
    value = lambda at: toxicity._sigmoid(m.bias + toxicity._machine_sum(m.w, m.v, 1 + np.array(at), np.zeros(len(at), int), 1)[0])[0]
    assert value([0, 1, 3]) > 0.8 and value([0, 3]) < 0.3 and value([1, 3]) < 0.3  # every row has a third term
    assert abs(float(m.v[1] @ m.v[2])) > 0.1


def test_machine_sum_by_brute_force():
    """The factorised sum against every pair, one by one."""
    r = np.random.default_rng(4)
    w, v = r.normal(size=9), r.normal(size=(9, toxicity.FACTORS))
    rows = [r.choice(9, k, replace=False) for k in (0, 1, 2, 5, 9)]
    got, _ = toxicity._machine_sum(w, v, np.concatenate(rows).astype(int), np.repeat(np.arange(5), [len(x) for x in rows]), 5)
    naive = [w[x].sum() + sum(v[i] @ v[j] for i, j in itertools.combinations(x, 2)) for x in rows]
    assert np.allclose(got, naive)


def test_pairs_pass_the_screen(spark):
    """Two words of which neither says anything alone: toxic where both or none are there."""
    r = np.random.default_rng(6)
    rows = []
    for i in range(900):
        a, b = (r.random(2) < 0.5).astype(int)
        words = [*prose(25, 70_000 + i).split(), *(["vequa"] * a), *(["blim"] * b)]
        rows.append((i, " ".join(r.permutation(words)), int(a == b)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 700], "doc_id int, toxic int")
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    machine = toxicity.train(docs, labels)
    buckets = [zlib.crc32(w.encode()) % toxicity.BUCKETS for w in ("vequa", "blim")]
    assert all(machine.place[b] for b in buckets)
    got = {x.doc_id: x.score for x in toxicity.score(docs.select("doc_id", "text"), machine).collect()}
    both = [(y, got[i]) for i, t, y in rows if i >= 700 and "vequa" in t]
    assert np.mean([s for y, s in both if y]) > np.mean([s for y, s in both if not y]) + 0.4


def test_factors_decide_planted_pairs(spark):
    """At sf0.1: two words added to documents, toxic together only; without the factors held-out rows are less likely."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").join(labels, "doc_id").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(12)))
    added = F.when(F.col("h") < 2, " vequa").when(F.col("h") < 4, " blim").when(F.col("h") < 6, " blim and vequa").otherwise("")
    rows = rows.withColumn("text", F.concat("text", added)).withColumn("toxic", F.when(F.col("h").isin(4, 5), 1).otherwise(F.col("toxic")))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    machine = toxicity.train(rows.select("doc_id", "text"), rows.where(~held).select("doc_id", "toxic"))
    planted = rows.where(held & (F.col("h") < 6)).toPandas()
    y = planted["toxic"].to_numpy()
    scores = [m.scores(planted["text"], {}) for m in (machine, machine._replace(v=np.zeros_like(machine.v)))]
    loss, linear = (-np.log(np.where(y == 1, s, 1 - s) + 1e-12).mean() for s in scores)
    right, linear_right = (((s >= 0.7) == (y == 1)).mean() for s in scores)
    assert loss < 0.1 < linear and right > 0.95 > linear_right


def test_toxicity_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id int, toxic int")
    docs = frame(spark, [])
    assert toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, none)).count() == 0


def test_risk_and_gradient_by_brute_force():
    """The fit's gradient is that of the non-negative risk, term by term, on both sides of nought."""
    r = np.random.default_rng(9)
    for prior in (0.3, 0.9):
        logits = r.normal(size=12) + (3 if prior == 0.9 else 0)
        sp, su = quality._sigmoid(logits[:5]), quality._sigmoid(logits[5:])
        risk, gp, gu = quality.pu_risk(sp, su, prior)
        positive = prior * np.mean([-np.log(s) for s in sp])
        negative = np.mean([-np.log(1 - s) for s in su]) - prior * np.mean([-np.log(1 - s) for s in sp])
        assert np.isclose(risk, positive + max(0.0, negative))
        # below nought the step goes back up the negative part alone
        goal = (lambda z: quality.pu_risk(quality._sigmoid(z[:5]), quality._sigmoid(z[5:]), prior)[0]) if negative >= 0 else (
            lambda z: prior * np.mean(-np.log(1 - quality._sigmoid(z[:5]))) - np.mean(-np.log(1 - quality._sigmoid(z[5:]))))
        for k in range(12):
            up, down = logits.copy(), logits.copy()
            up[k] += 1e-5
            down[k] -= 1e-5
            assert np.isclose((goal(up) - goal(down)) / 2e-5, np.concatenate([gp, gu])[k], atol=1e-6)


def test_quality_of_nothing(spark):
    docs = frame(spark, [])
    none = spark.createDataFrame([], "doc_id int, quality int")
    assert quality.score(docs, quality.train(docs, none)).count() == 0


def test_quality(spark):
    good = [(i, ". ".join(prose(12, 3_000 + 10 * i + k).capitalize() for k in range(5)) + ".") for i in range(300)]
    junk = [(1_000 + i, " ".join(f"{w}{'#$%&'[k % 4] * 3}" for k, w in enumerate(prose(60, 9_000 + i).split()))) for i in range(60)]
    docs = frame(spark, good + junk + [(None, "x"), (5_000, None), (5_001, ""), (5_002, LONG)])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:250]] + [(i, 0) for i, _ in junk[:50]] + [(7, None)], "doc_id int, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all(got[i] >= 0.3 for i, _ in good[250:]) and all(got[i] < 0.3 for i, _ in junk[50:]) and all(0 <= s <= 1 for s in got.values())
    assert quality.score(docs, quality.train(docs, labels.limit(0))).first().score == 0.5


def test_prior_estimate():
    r = np.random.default_rng(2)
    p, n = r.normal(1, 1, (1_500, quality.STATS)), r.normal(-1, 1, (600, quality.STATS))
    assert 0.42 < quality.estimate_prior(p[:700], np.concatenate([p[700:], n])) < 0.6  # the truth, 0.571, less a margin


# ------------------------------------------------------------------ sharding


def test_min_cost_flow_by_brute_force():
    r = np.random.default_rng(8)
    for _ in range(60):
        n_old, n_new = int(r.integers(1, 4)), int(r.integers(1, 4))
        sizes = [list(r.integers(1, 30, int(r.integers(0, 4)))) for _ in range(n_old)]
        total = sum(map(len, sizes))
        blocks = [(o, k, 1, int(b)) for o, s in enumerate(sizes) for k, b in enumerate(s)]
        plan = resharding.solve_moves(blocks, n_new)
        moved = sum(b for o, k, _, b in blocks for p in plan if (p[0], p[1]) == (o, k) and p[4] != o)
        count = Counter(p[4] for p in plan for _ in range(p[3] - p[2]))
        room = [total // n_new + (j < total % n_new) for j in range(n_new)]
        assert [count[j] for j in range(n_new)] == room
        best = min((sum(b for (o, _, _, b), j in zip(blocks, way, strict=True) if o != j) for way in itertools.product(range(n_new), repeat=total) if [way.count(j) for j in range(n_new)] == room), default=0)
        assert moved == best


def test_reshard(spark, tmp_path):
    rows = CASES + [(100 + k, prose(k % 50, k)) for k in range(200)]
    got = resharding.reshard(frame(spark, rows), F.pmod(F.xxhash64("doc_id"), F.lit(3)), 5).toPandas()
    assert len(got) == len(rows) and got["shard"].value_counts().max() - got["shard"].value_counts().min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == want
    assert resharding.reshard(frame(spark, []), F.lit(0), 5).count() == 0
    # the smallest rows of every shard that has too many move, to a sixteenth of a size class
    room = len(rows) // 5
    best = sum(sum(sorted(g["size"])[: max(0, len(g) - room - 1)]) for _, g in got.groupby("old_shard"))
    assert best <= got[got["shard"] != got["old_shard"]]["size"].sum() <= 1.1 * sum(sum(sorted(g["size"])[: max(0, len(g) - room)]) for _, g in got.groupby("old_shard"))


def in_layout(spark, layout):
    return sorted([(r[resharding.SHARD], r.doc_id, r.text, r.lang) for r in resharding.read_layout(spark, layout).collect()], key=repr)


def test_layouts(spark, tmp_path):
    """Growing and shrinking stored layouts: every row once, folders without changes untouched, emptied shards gone."""
    rows = CASES + [(100 + k, prose(k % 50, k)) for k in range(60)]
    docs = frame(spark, rows).withColumn(resharding.SLOT, F.lit("mine"))
    first = resharding.store_layout(docs, F.pmod(F.xxhash64("doc_id"), F.lit(3)), str(tmp_path / "a"))
    grown = resharding.reshard_layout(spark, first, 5, str(tmp_path / "b"))
    shrunk = resharding.reshard_layout(spark, grown, 2, str(tmp_path / "c"))
    texts = sorted(((i, t, "en") for i, t in rows), key=repr)
    for layout, n in ((first, 3), (grown, 5), (shrunk, 2)):
        got = in_layout(spark, layout)
        assert set(layout.folders) == {r[0] for r in got} == set(range(n)) and sorted([r[1:] for r in got], key=repr) == texts
    for layout in (grown, shrunk):
        by_shard = resharding.read_layout(spark, layout).groupBy(resharding.SHARD).agg(F.sort_array(F.collect_list(resharding.SLOT)).alias("slots")).collect()
        assert all(r.slots == list(range(len(r.slots))) for r in by_shard) and max(len(r.slots) for r in by_shard) - min(len(r.slots) for r in by_shard) <= 1
    same = resharding.reshard_layout(spark, grown, 5, str(tmp_path / "d"))
    assert same.folders == grown.folders and not (tmp_path / "d").exists()
    none = resharding.store_layout(docs.limit(0), F.lit(0), str(tmp_path / "e"))
    assert none.folders == {} and resharding.read_layout(spark, resharding.reshard_layout(spark, none, 5, str(tmp_path / "f"))).count() == 0


# ------------------------------------------------------------------ urls


def test_urls(spark):
    urls = {1: "https://A.Example.NET/en/x?q#f", 2: "http://foo.net", 3: "http://foo.net/", 4: None, 5: "no scheme", 6: "http://x.org/fr/1", 7: "http://www.example.com/de/a", 8: "x://h#/de/", 9: "http://notexample.net/en/"}
    pages = spark.createDataFrame([(i, u, "z") for i, u in urls.items()] + [(None, "http://x.org/", "z")], "page_id int, url string, host string")
    outcomes = spark.createDataFrame([(1, 0), (None, 1), (3, None)], "page_id int, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("foo.net", "", None, "allow") and got[3] == ("foo.net", "/", "net/", "block")
    assert got[4][:3] == got[5][:3] == ("", "", None) and got[6][2:] == ("org/fr/", "allow") and got[7][2:] == ("example.com/de/", "block")
    assert got[8][:2] == ("h", "") and got[9][2:] == ("net/", "block") and len(got) == 10


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.org": ("x.org", "org"), "h.x.org:8080": ("x.org", "org"), "u:p@h.x.org": ("x.org", "org"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]",) * 2, "": ("", ""), "local": ("local", "local"), "co.uk": ("co.uk", "co.uk"), "x.org.": ("x.org", "org")}
    got = {r.host: (r.domain, r.suffix) for r in url_reputation.with_domain(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()}
    assert got == hosts


def reputation(spark, rows):
    got = url_reputation.host_reputation(spark.createDataFrame(rows, "host string, n long, k long"))
    return {r.host: r for r in got.select("host", "a", "b", url_reputation.lower_bound(F.col("a"), F.col("b")).alias("lower")).collect()}


def test_reputation_shrinks(spark):
    rows = [(f"h{i}.bad.xyz", 50, 48) for i in range(5)] + [(f"h{i}.fine.xyz", 50, 1) for i in range(5)] + [("new.bad.xyz", 1, 0), ("new.fine.xyz", 1, 1), ("never.bad.xyz", 0, 0)]
    got = reputation(spark, rows)
    rate = {h: r.a / (r.a + r.b) for h, r in got.items()}
    assert rate["h0.bad.xyz"] > 0.9 and rate["h0.fine.xyz"] < 0.1 and rate["new.bad.xyz"] > 0.5 > rate["new.fine.xyz"] and rate["never.bad.xyz"] > 0.8
    assert got["h0.bad.xyz"].lower > 0.5 > got["new.fine.xyz"].lower


def test_reputation_needs_evidence(spark):
    """One bad page, or three of five, block no host that has no bad company; forty of forty do."""
    rows = [(f"www.site{i}.com", 1 + i % 7, 0) for i in range(40)] + [("www.one.com", 1, 1), ("www.some.com", 5, 3), ("www.all.com", 40, 40)]
    got = reputation(spark, rows)
    assert got["www.one.com"].lower < 0.3 and got["www.some.com"].lower < 0.5 < got["www.all.com"].lower
    assert all(r.a + r.b < 2 * sum(n for _, n, _ in rows) for r in got.values())  # no prior outweighs the evidence
    alone = reputation(spark, [("only.org", 1, 1)])["only.org"]
    assert alone.lower < 0.5 and alone.a + alone.b <= 2
    assert reputation(spark, []) == {} and reputation(spark, [("x.org", 0, 0)])["x.org"].lower < 0.5


def test_usual_odds():
    assert url_reputation.usual_odds(0, 0, 1) == 0.5 and abs(url_reputation.usual_odds(1_000_000, 250_000) - 0.5) < 1e-3
    assert url_reputation.usual_odds(100, 90) > 0.9  # where most pages are bad, only more of them block


def test_three_bad_rows_of_one_host(spark):
    """Three bad pages of a host among many good ones do not block it, however often their rows are repeated."""
    pages = spark.createDataFrame([(i, f"http://www.site{i}.org/en/{i}.html") for i in range(40)] + [(100 + i, f"http://one.org/en/{100 + i}.html") for i in range(3)], "page_id int, url string")
    outcomes = spark.createDataFrame([(i, 0) for i in range(40)] + [(100 + i, 1) for i in range(3)], "page_id int, bad int")
    for times in (1, 2, 4):
        some = pages
        for _ in range(times - 1):
            some = some.union(pages)
        got = {r.page_id: (r.verdict, r.bad_lower) for r in url_reputation.judge_urls(some, outcomes, bad_rate=0.5).collect()}
        if times == 1:
            want = got
        assert got == want and got[100][0] == "allow"


def test_urls_blocked_by_reputation(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'good'}.example.org/en/{i}.html", "t") for i in range(80)] + [(200, "http://spam.example.org/x", "t"), (201, "http://spam.example.org/fr/", "t")], "page_id int, url string, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(None, 0, 0), (61, None, None)], "doc_id long, quality int, toxic int")
    # rows that repeat a page are judged like it and are no evidence
    once = {(r.page_id, r.verdict, r.bad_lower) for r in url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages, labels)).collect()}
    many = pages.union(pages).union(pages)
    again = url_reputation.judge_urls(many, url_reputation.page_outcomes(many, labels)).collect()
    assert {(r.page_id, r.verdict, r.bad_lower) for r in again} == once and len(again) == 3 * 82
    got = {r.page_id: (r.verdict, r.rule) for r in url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages, labels)).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow", None) for i in range(80)) and got[200] == ("block", None) and got[201] == ("allow", "org/fr/")
    assert url_reputation.judge_urls(pages.limit(0), url_reputation.page_outcomes(pages, labels.limit(0))).count() == 0


# ------------------------------------------------------------------ packing


def test_tokens_are_those_of_the_tokenizer():
    t = packing.ByteTokens(packing.tokenizer_file())
    samples = [*[x for _, x in CASES if x], "a\n\nb  c\t'll we're \xa0x  ", "<|endoftext|> hi", "   ", "x²½ a1b2", "''s don't \r\n z", " lead", "trail ", "日本語 text", "😀 a\u2028b", "\x1c\x1d x"]
    assert all(t.ids(s) == t.whole(s) for s in samples)


_tokens = packing.ByteTokens(packing.tokenizer_file())
_latin = st.text(st.sampled_from("abzAZéßÿʼɏ09²¾ \t\n\r\xa0'`.,;:!?-_&#%sdtrevml"), max_size=60)
_contractions = st.lists(st.sampled_from(["'s", "'T", "we're", " ", "  ", "\n", " \n", "a1", "x", "…", "\x1f", "<|endoftext|>", "日本", "é"]), max_size=20).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), _latin, _contractions))
def test_tokens_of_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert _tokens.ids(text) == _tokens.whole(text)


def test_packing(spark):
    rows = [*CASES, *[(100 + k, prose(10 + 7 * k % 300, k)) for k in range(150)]]
    got = packing.pack_documents(frame(spark, rows), packing.tokenizer_file()).toPandas()
    tokens = packing.ByteTokens(packing.tokenizer_file())
    expected = Counter()
    for i, t in rows:
        raw = (tokens.whole(t) if t else b"") + (2).to_bytes(4, "little")
        n = len(raw) // 4
        cut = [0, *range(n % 1024 or 1024, n + 1, 1024)]
        expected.update((-1 if i is None else i, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)))
    assert Counter((-1 if pd.isna(r.doc_id) else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == expected
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= 1.05 * -(-got["length"].sum() // 1024) + 1
    assert packing.pack_documents(frame(spark, []), packing.tokenizer_file()).count() == 0


def test_plan_places_every_piece():
    h = np.random.default_rng(1).poisson(3, 1025)
    h[0] = 0
    plan, n = packing.pack_plan(h)
    done = np.zeros(1025, int)
    fill = np.zeros(n, int)
    for length, a, b, seq, _ in plan:
        done[length] += b - a
        fill[seq : seq + b - a] += length
    assert (done == h).all() and fill.max() <= 1024 and n <= 1.01 * (h * np.arange(1025)).sum() / 1024 + 2


# ------------------------------------------------------------------ transport streams


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.integers(0, 40_000).map(lambda n: bytes(n))))
def test_stream_round_trip(payload):
    raw = media.encode(payload)
    x = media.parse(raw)
    assert x["payload"] == payload and x["cc_errors"] == 0 and len(raw) % 188 == 0 and x["units"][0][2]
    assert [u[0] for u in x["units"]] == [i * media.UNIT * 90_000 // 8_000 for i in range(len(x["units"]))]


def test_stream_faults(spark):
    raw = media.encode(bytes(range(256)) * 20)
    lost = raw[: 188 * 5] + raw[188 * 6 :]
    assert media.parse(lost)["cc_errors"] == 1 and media.parse(lost)["lost"] >= 1 and len(media.parse(lost)["payload"]) < 256 * 20
    again = raw[: 188 * 6] + raw[188 * 5 :]  # a packet sent twice
    assert media.parse(again)["cc_errors"] == 0 and media.parse(again)["payload"] == bytes(range(256)) * 20
    long = media.encode(bytes(60_000))
    tables = [k for k in range(0, len(long), 188) if long[k + 1 : k + 3] == b"\x40\x00"]
    assert media.parse(long)["cc_errors"] == 0 and len(tables) == 2
    renumbered = bytearray(long)
    renumbered[tables[1] + 3] = 0x10 | 9  # the counter of a table breaks
    assert media.parse(bytes(renumbered))["cc_errors"] == 1
    told = bytearray(raw[: 188 * 4] + raw[188 * 6 :])
    k = next(k for k in range(188 * 4, len(told), 188) if told[k + 3] & 0x20 and told[k + 4])
    told[k + 5] |= 0x80
    assert media.parse(bytes(told))["cc_errors"] <= 1
    rows = spark.createDataFrame([(1, bytearray(raw), "x"), (2, None, "x"), (3, bytearray(b"junk"), "x"), (4, bytearray(raw[:4] + b"\x01" + raw[5:]), "x")], "doc_id int, media binary, units string")
    got = {r.doc_id: r for r in media.parse_streams(rows).collect()}
    assert got[1].error is None and got[2].error and got[3].error and got[4].error and bytes(got[1].read_payload) == bytes(range(256)) * 20
    gone = spark.createDataFrame([(1, bytearray(lost))], "doc_id int, media binary")
    assert "lost" in media.parse_streams(gone).first().error and media.parse_streams(gone.limit(0)).count() == 0
    payloads = spark.createDataFrame([(1, None), (2, bytearray(b"abc"))], "doc_id int, payload binary")
    assert {r.doc_id: bytes(r.read_payload) for r in media.parse_streams(media.encode_streams(payloads)).collect()} == {1: b"", 2: b"abc"}
    assert media.encode_streams(payloads.limit(0)).count() == 0


def test_two_programs():
    """A second program, its packets between those of the first, is listed and reassembled too; tables may span packets."""
    one, two = bytes(range(200)) * 90, b"other" * 4_000
    pat_body = bytes([0, 1, 0xE0 | media.PMT_PID >> 8, media.PMT_PID & 255, 0, 2, 0xE0 | 0x11, 0x00])
    pmt = lambda es, extra: bytes([0xE0 | es >> 8, es & 255, 0xF0, 0, 6, 0xE0 | es >> 8, es & 255, 0xF0 | extra >> 8, extra & 255]) + bytes(extra)

    def split(pid, table, number, body):
        length = 5 + len(body) + 4
        section = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
        section = b"\0" + section + media.section_crc(section).to_bytes(4, "big")
        parts = [section[k : k + 184] for k in range(0, len(section), 184)]
        return [(bytes([0x47, (0 if k else 0x40) | pid >> 8, pid & 255, 0x10 | k]) + p).ljust(188, b"\xff") for k, p in enumerate(parts)]

    es = lambda raw: [raw[k : k + 188] for k in range(0, len(raw), 188) if raw[k + 1] & 31 == media.ES_PID >> 8 and raw[k + 2] == media.ES_PID & 255]
    first, second = es(media.encode(one)), [p[:1] + bytes([p[1] & 0xE0 | 2]) + p[2:] for p in es(media.encode(two))]
    mixed = [p for pair in itertools.zip_longest(first, second) for p in pair if p]
    head = split(0, 0, 1, pat_body) + split(media.PMT_PID, 2, 1, pmt(media.ES_PID, 0)) + split(0x1100, 2, 2, pmt(0x0200 | media.ES_PID & 255, 300))
    got = media.parse(b"".join(head + mixed))
    assert [(n, [s[0] for s in listed]) for n, _, listed in got["programs"]] == [(1, [media.ES_PID]), (2, [0x0200 | media.ES_PID & 255])]
    assert [d for _, d, _ in got["streams"]] == [one, two] and got["cc_errors"] == 0 and got["payload"] == one


# ------------------------------------------------------------------ queries and pipeline


def test_pipeline_by_brute_force(spark, tmp_path):
    """Near-duplicates, repeats and leaks of the pipeline's stages on what their predecessors kept."""
    import corpus_pipeline

    item = prose(30, 77)
    passage = prose(90, 78)
    text = lambda k: ". ".join(prose(12, 50_000 + 10 * k + j).capitalize() for j in range(8)) + "."
    rows = [(k, text(k)) for k in range(200)] + [(300, text(0)), (301, text(1) + " end"), (302, f"{text(400)} {item}"), (303, f"{text(401)} {passage}"), (304, f"{text(402)} {passage}")]
    rows += [(500 + k, " ".join(f"{w}###" for w in prose(50, 60_000 + k).split())) for k in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in kept.collect()}
    assert set(seen["quality classifier"]) == {i for i, _ in rows if i < 500}
    expected = components_by_brute_force([(i, t) for i, t in rows if i < 500])
    assert set(seen["near-duplicates"]) == {i for i, (_, top) in expected.items() if i == top}
    before = sorted(seen["near-duplicates"].items())
    for (i, _), (_, _, _, left) in zip(before, removed_by_brute_force([t for _, t in before], corpus_pipeline.PASSAGE_BYTES), strict=True):
        assert seen["repeated passages"][i].encode() == left
    assert set(seen["repeated passages"]) - set(seen["decontamination"]) == {302}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} == set(seen["decontamination"])


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null ids, null and empty and long texts, repeated rows, clashing columns and empty tables through every stage."""
    import corpus_pipeline

    item, passage = prose(30, 77), prose(60, 79)
    rows = [*CASES, (None, prose(40, 81)), (None, prose(40, 81)), (None, f"{prose(40, 82)} {item}"), (30, prose(40, 81)), (31, f"{prose(9, 83)} {passage}"), (32, f"{prose(9, 84)} {passage}"), (None, None), (None, "")]
    names = "doc_id long, text string, _quality string, _row string, _key string, _spans string, score string"
    docs = spark.createDataFrame([(i, t, "q", "r", "k", "s", "x") for i, t in rows], names)
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            got = stage(spark, given, str(tmp_path))
            assert got.columns == docs.columns
            out[name] = found = got.collect() if given is docs else out[name]
            assert given is docs or got.count() == 0
            assert all((r["_quality"], r["_row"], r["_key"], r["_spans"], r["score"]) == ("q", "r", "k", "s", "x") for r in found)
    assert len(out["quality classifier"]) == len(rows)  # nothing to learn from: nothing is rejected
    kept = Counter((r.doc_id, r.text) for r in out["near-duplicates"])
    assert kept[30, prose(40, 81)] == 1 and not kept[None, prose(40, 81)] and kept[3, "one"] == 1 and not kept[4, "one"]
    assert kept[None, f"{prose(40, 82)} {item}"] == kept[None, None] == kept[None, ""] == 1
    cut = {r.doc_id: r.text for r in out["repeated passages"]}
    assert passage not in cut[31] + cut[32] and cut[0] is None and cut[6] == LONG
    assert not any(item in (r.text or "") for r in out["decontamination"]) and len(out["decontamination"]) == len(rows) - 1
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len({i for i, _ in rows})


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_html_main", "op5_toxicity", "op6_resharding", "op7_url_reputation", "op8_quality", "op10_media"])
def test_queries_keep_every_row(spark, name):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    got = __spark_entry__.queries()[name](spark, sf)
    table = "pages" if name in ("op2_html_main", "op7_url_reputation") else "documents"
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert got.count() == n if name != "op1_decontamination" else re.match("doc_id", got.columns[0])
