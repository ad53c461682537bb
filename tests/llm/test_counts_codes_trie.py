"""Token counts, vector codes and the conversation trie against brute force, with the odd rows that each one states."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import token_counts, turn_trie, vector_codes
from rankloom.llm.packing import tokenizer_file

# ------------------------------------------------------------------ token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(tokenizer_file())


def counts_of(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = ["", "a", " ", "  a", "a  ", "'s", "''s", "it's  we'll 've\n\n x", "<|endoftext|>", " <|endoftext|>  <|endoftext|><|endof", "=" * 300, " " * 300 + "x", "ab" * 3000, "!'s 's", "\x00\x85　é漢🙂", "é" * 900]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'sStrevmld\n\t12!é<|endoftext|>", max_size=60)), min_size=1, max_size=4))
def test_counts_of_any_text(library, counter, texts):
    assert counter.counts(texts).tolist() == counts_of(library, texts)


@pytest.mark.parametrize(("slice_", "group", "lockstep"), [(1 << 19, 1 << 16, 48), (100, 40, 5), (17, 1, 1)])
def test_counts_in_slices(library, monkeypatch, slice_, group, lockstep):
    monkeypatch.setattr(token_counts, "SLICE", slice_)
    monkeypatch.setattr(token_counts, "GROUP", group)
    monkeypatch.setattr(token_counts, "LOCKSTEP", lockstep)
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("ab cd'sStrevmldll\n\t  12é漢🙂-=_.") for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    small = token_counts.TokenCounter(tokenizer_file(), states=50)  # states are forgotten over and over
    assert small.counts(texts).tolist() == counts_of(library, texts)


def test_prefix_scan_composes_in_order():
    maps = np.random.default_rng(1).integers(0, 8, (37, 8)).astype(np.uint8)
    now = np.arange(8)
    for row, got in zip(maps, token_counts.scanned(maps), strict=True):
        now = row[now]
        assert (got == now).all()


def test_token_counts_query(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, None), (3, "twice"), (3, "twice"), (9, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, n_bytes string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, tokenizer_file()).collect() if r.doc_id is not None)
    want = sorted((i, len((t or "").encode()), n) for (i, t), n in zip(rows, counts_of(library, [t or "" for _, t in rows]), strict=True) if i is not None)
    assert got == want
    assert token_counts.count_tokens(docs.where("false"), tokenizer_file()).count() == 0


def test_token_counts_of_the_tables(spark, library):
    got = {r.doc_id: r for r in token_counts.op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, n in zip(docs, counts_of(library, [d.text or "" for d in docs]), strict=True):
        assert (got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (n, n > 1024)


# ------------------------------------------------------------------ vector codes


def codes_by_brute_force(rows, entries, rounds=4, parts=4):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v], label))
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(order[0][1])
    kept, order = [r for r in kept if len(r[1]) == size], [r for r in order if len(r[1]) == size]
    width = size // parts
    books = [[r[1][p * width : (p + 1) * width] for r in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[nearest(v[p * width : (p + 1) * width], books[p])[1]].append(v[p * width : (p + 1) * width])
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if of[k] else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        found = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, label, [k for _, k in found], sum(d for d, _ in found)))
        by_label[label] += out[-1][3]
    return out, books


def some_vectors(seed, n, spread):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rnd.integers(-spread, spread + 1, 8) / 1024)], int(i) % 3 if i % 5 else None) for i in rnd.permutation(n)]
    rows += [(n + k, rows[0][1], 7) for k in range(n // 2)]  # one vector in many rows
    return [*rows, rows[3], (n * 2, None, 1), (n * 2 + 1, [0.1] * 7 + [None], 1), (n * 2 + 2, [float("nan")] * 8, 1), (n * 2 + 3, [float("inf")] + [0.0] * 7, 1), (n * 2 + 4, [0.5] * 4, 1), (None, [0.25] * 8, None)]


@pytest.mark.parametrize(("spread", "entries"), [(2, 8), (40, 16), (3, 256), (900_000, 12)])
def test_codes(spark, spread, entries):
    rows = some_vectors(spread, 90, spread)
    df = spark.createDataFrame([(i, v, label, "c", 0) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    got, books = vector_codes.compress(df, entries=entries)
    want, want_books = codes_by_brute_force(rows, entries)
    assert [b.tolist() for b in books] == want_books
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or 0, r[2])
    assert sorted([(r.vec_id, r.label, r.codes, r.error) for r in got.collect()], key=key) == sorted(want, key=key)


def test_bounds_save_scans():
    rnd = np.random.default_rng(4)
    middle = rnd.integers(-4000, 4000, (20, 16))
    x = middle[rnd.integers(0, 20, 3000)] + rnd.integers(-30, 30, (3000, 16))
    book = vector_codes.Codebook(middle)
    code, upper, lower = book.scan(x)
    moved = vector_codes.Codebook(middle + rnd.integers(-5, 5, middle.shape), middle)
    assert moved.assign(x, code, upper, lower) < 100
    assert (code == vector_codes.distances(x, moved.entries).argmin(1)).all()


def test_ties_reach_the_scan():
    x = np.array([[0, 0], [4, 0], [2, 0]])
    book = vector_codes.Codebook(np.array([[4, 0], [0, 0]]))
    code, upper, lower = book.scan(x)
    assert code.tolist() == [1, 0, 0]
    code[2] = 1  # as near, but not the lower index
    assert vector_codes.Codebook(book.entries, book.entries).assign(x, code, upper, lower) >= 1
    assert code.tolist() == [1, 0, 0]


def test_codes_of_nothing_and_too_large(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty)[0].count() == 0
    large = spark.createDataFrame([(1, [1e6] * 8, 1)], empty.schema)
    with pytest.raises(ValueError, match="fit a long"):
        vector_codes.compress(large)


# ------------------------------------------------------------------ conversation trie


def trie_by_brute_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


TURNS = "conv_id long, turn long, role string, text string, depth int, node string, key string, at long"


def trie_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(430), 120):
        for t in range(rnd.randint(1, 7)):
            rows.append((c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "bot", None]), rnd.choice(["hi", "é漢", "", None, "what then?"])))
    rows += [(c, t, "user", "the same") for c in range(500, 560) for t in range(9)]  # deep copies
    rows += [(700, 1, "user", f"line {k % 50}") for k in range(300)]  # one conversation of many turns, all tied
    rows += [(701, t, "user", "hi") for t in range(3)] * 2 + [(None, 1, "user", "lost"), (123_456_789_012, 0, "a", "b"), (5, None, None, None)]
    return rows


@pytest.mark.parametrize("piece", [4096, 7])
def test_trie(spark, monkeypatch, piece):
    monkeypatch.setattr(turn_trie, "PIECE", piece)
    rows = trie_rows(piece)
    df = spark.createDataFrame([(*r, 1, "n", "k", 2) for r in rows], TURNS).repartition(5)
    got = sorted((tuple(r) for r in turn_trie.prefix_trie(df).select(*turn_trie.NODE).collect()), key=lambda r: (r[1], r[0]))
    assert got == trie_by_brute_force(rows)


def test_trie_of_little(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turn_trie.prefix_trie(empty).count() == 0
    one = [(1, 0, "user", "x"), (2, 0, "user", "x")]  # both take more turns than there are: only the root is left
    df = spark.createDataFrame([(*r, 1, "n", "k", 2) for r in one], TURNS)
    assert [tuple(r) for r in turn_trie.prefix_trie(df).collect()] == trie_by_brute_force(one)


def test_trie_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in turn_trie.op13_turn_trie(spark, "/root/testdata/sf0.001").select(*turn_trie.NODE).collect()), key=lambda r: (r[1], r[0]))
    assert got == trie_by_brute_force(rows)
    assert spark.range(1).select(turn_trie.taken("id")).first()[0] == zlib.crc32(b"0") % 6
