"""Token counts by transducers compiled from a byte-level BPE tokenizer.

Counting needs no ids, so the tokenizer becomes two deterministic machines whose
transitions say how many tokens they emit:

1. ``Splitter`` reads character classes (letter, number, space, other) and finds
   where pre-tokens begin.  It has eight states, so a chunk of text is summed up
   by its state map, the exit state for each entry state.  The maps of all chunks
   are built in step with each other and composed by a parallel prefix scan,
   which gives each chunk its true entry state.
2. ``Merger`` reads bytes and restarts at each pre-token.  After every prefix it
   knows the last token of that prefix's encoding: among the tokens that end
   there, just one fits the last token of the prefix before it, since a token
   sequence is an encoding if and only if each adjacent pair is.  A state is what
   later bytes can still ask about: the last tokens (and counts) at the places
   where a longer token may begin.  A transition emits the difference of the
   counts of two prefixes, which may be negative.  States are determinised when
   first reached, and built anew where their table is full (``STATES``).

A restart sends every state of the second machine to its first, so the maps of
its chunks are constant and compose by adding; chunks are cut at restarts.  A
pre-token longer than ``LOCKSTEP`` bytes is followed by itself.

Batches of texts are read as one stream in slices of ``SLICE`` characters that
hand on both states, so memory does not depend on the length of a text.  Strings
of added tokens (``<|endoftext|>``) count one each and part the text around them.

Defined results: a null or empty text has no bytes and no tokens; equal texts have
equal counts; repeated rows and rows without an id stay; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import bound_batches, pick, table
from rankloom.llm.packing import tokenizer_file

LIMIT = 1024
CHUNK, SLICE, LOCKSTEP, GROUP, STATES = 64, 1 << 19, 48, 1 << 16, 1 << 18
SPREAD, OFFSET = 0x2545F491, 1 << 15
BREAK = 0x110000  # a code that no text has: parts texts

LETTER, NUMBER, OTHER, SPACE, PARTED, UNKNOWN = range(6)
#: The endings that follow an apostrophe as one pre-token.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def plain_bytes() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: itself where printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


# ---------------------------------------------------------------- the first machine


class Splitter:
    """Where the pre-tokens of a stream of code points begin."""

    #: What the character before was: in a run of letters, numbers or others, a blank that opens the next run, a
    #: white-space token, an apostrophe ending with two, one or no characters to come.
    IN_LETTERS, IN_NUMBERS, IN_OTHERS, OPEN, IN_SPACE, TWO, ONE, DONE = range(8)
    #: Symbols: a class, with what lies ahead where that matters.
    SYMBOLS = ("letter", "number", "other", "quote2", "quote3", "space", "last space", "last blank", "break")

    def __init__(self, pre_tokenize):
        """``pre_tokenize`` gives (piece, (from, to)) of a text; it is asked about each character once."""
        self.pre_tokenize = pre_tokenize
        self.classes = np.full(BREAK + 1, UNKNOWN, np.uint8)
        self.classes[BREAK] = PARTED
        self.next, self.begins = self._compile()

    def _compile(self) -> tuple[np.ndarray, np.ndarray]:
        run = {"letter": self.IN_LETTERS, "number": self.IN_NUMBERS, "other": self.IN_OTHERS}
        after = np.zeros((len(self.SYMBOLS), 8), np.uint8)
        begins = np.ones((len(self.SYMBOLS), 8), bool)
        for k, symbol in enumerate(self.SYMBOLS):
            for state in range(8):
                kind = "other" if symbol.startswith("quote") else symbol
                if state in (self.TWO, self.ONE) and symbol != "break":
                    after[k, state], begins[k, state] = (self.ONE if state == self.TWO else self.DONE), False
                elif kind in run:
                    goes_on = state in (run[kind], self.OPEN)
                    begins[k, state] = not goes_on
                    ending = symbol.startswith("quote") and not goes_on
                    after[k, state] = (self.ONE if symbol == "quote2" else self.TWO) if ending else run[kind]
                elif symbol == "space":
                    after[k, state], begins[k, state] = self.IN_SPACE, state != self.IN_SPACE
                elif symbol == "last blank":
                    after[k, state] = self.OPEN
                else:  # a last space that opens nothing, or the end of a text: what comes next begins
                    after[k, state] = self.DONE
        begins[self.SYMBOLS.index("break")] = False
        return after, begins

    def learn(self, codes: np.ndarray) -> None:
        """Class of each new code point, by how the tokenizer splits it from its neighbours."""
        new = np.unique(codes[self.classes[codes] == UNKNOWN])
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            cuts = np.zeros(6 * len(some) + 1, bool)
            cuts[[a for _, (a, _) in self.pre_tokenize("".join([f"a{chr(c)}1a{chr(c)}!" for c in some.tolist()]))]] = True
            before, after = cuts[1:-1:6], cuts[2::6]
            with_other = ~cuts[5::6]
            self.classes[some] = np.select([some == 32, ~before, ~after, with_other], [SPACE, LETTER, NUMBER, OTHER], SPACE)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbol of each code but the last three, which are only looked at."""
        self.learn(codes)
        kind = self.classes[codes]
        n = len(codes) - 3
        now, ahead = kind[:n], kind[1 : n + 1]
        out = np.array([0, 1, 2, 5, 8], np.uint8)[now]
        last = (now == SPACE) & (ahead != SPACE) & (ahead != PARTED)
        out[last] = np.where(codes[:n][last] == 32, 7, 6)
        quotes = np.flatnonzero(codes[:n] == 39)
        if len(quotes):
            one, two = codes[quotes + 1], codes[quotes + 2]
            for ending in ENDINGS:
                fits = one == ord(ending[0])
                if len(ending) == 2:
                    fits &= two == ord(ending[1])
                out[quotes[fits]] = 2 + len(ending)
        return out

    def beginnings(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Whether a pre-token begins at each symbol, and the state after the last; ``state`` is the one before the first."""
        n = len(symbols)
        n_chunks = -(-n // CHUNK)
        padded = np.full(n_chunks * CHUNK, len(self.SYMBOLS), np.uint8)
        padded[:n] = symbols
        grid = np.ascontiguousarray(padded.reshape(n_chunks, CHUNK).T)
        flat = np.concatenate([self.next, np.arange(8, dtype=np.uint8)[None]]).reshape(-1)  # the padding changes nothing
        maps = np.tile(np.arange(8, dtype=np.uint8), (n_chunks, 1))
        for row in grid:
            maps = flat[(row.astype(np.uint16) * 8)[:, None] + maps]
        entry = scanned(maps)[:, state]
        now, entry = np.concatenate([[state], entry[:-1]]).astype(np.uint8), int(entry[-1])
        begins = np.empty((CHUNK, n_chunks), bool)
        starts = np.concatenate([self.begins, np.zeros((1, 8), bool)]).reshape(-1)
        for k, row in enumerate(grid):
            at = row.astype(np.uint16) * 8 + now
            begins[k], now = starts[at], flat[at]
        return begins.T.reshape(-1)[:n], entry


def scanned(maps: np.ndarray) -> np.ndarray:
    """Row i: the maps of rows 0 to i, one after the other (inclusive prefix scan by doubling)."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
        step *= 2
    return maps


# ---------------------------------------------------------------- the second machine


class Merger:
    """Counts of the encodings of byte strings, one state a prefix."""

    def __init__(self, vocabulary: dict[bytes, int], encode, most: int = STATES):
        """``encode`` gives the ids of a byte string that is one pre-token; it is asked about single tokens and pairs."""
        self.ids, self.encode, self.most = vocabulary, encode, most
        self.bytes_of = {i: b for b, i in vocabulary.items()}
        self.prefixes = {b[:k] for b in vocabulary for k in range(1, len(b))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.first = (b"", ((0, -1, 0),))
        self._forget()

    def _forget(self) -> None:
        self.states, self.number = [self.first], {self.first: 0}
        self.slots, self.used = 1 << 16, 0
        self.keys, self.values = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)

    def _number(self, state: tuple) -> int:
        """Number of a state, which is new or not."""
        if (found := self.number.get(state)) is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
        return found

    def _slots_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key (state * 256 + byte) is kept or would be, and whether it is there (open addressing)."""
        at = (keys * SPREAD >> 20) & (self.slots - 1)
        there = self.keys[at]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.slots - 1)
            there[open_] = found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return at, there == keys

    def _slot_of(self, key: int) -> int:
        at = (key * SPREAD >> 20) & (self.slots - 1)
        while (there := self.keys.item(at)) != key and there >= 0:
            at = (at + 1) & (self.slots - 1)
        return at

    def _put(self, key: int, value: int) -> None:
        if 2 * self.used >= self.slots:
            old = np.flatnonzero(self.keys >= 0)
            keys, values = self.keys[old], self.values[old]
            self.slots, self.used = 4 * self.slots, 0
            self.keys, self.values = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
            for k, v in zip(keys.tolist(), values.tolist(), strict=True):
                self._put(k, v)
        at = self._slot_of(key)
        self.keys[at], self.values[at] = key, value
        self.used += 1

    def _fit(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: begin) in an encoding."""
        if (found := self.fits.get((last, token))) is None:
            if len(self.fits) > 8 * self.most:
                self.fits.clear()
            ids = [token] if last < 0 else [last, token]
            found = self.fits[last, token] = self.encode(b"".join([self.bytes_of[i] for i in ids])) == ids
        return found

    def _build(self, key: int) -> int:
        """Put the transition of a state by a byte: the next state and the tokens emitted (16 bits, offset) in one number."""
        seen, places = self.states[key >> 8]
        seen += bytes([key & 255])
        n = len(seen)
        for back, last, count in places:  # from the longest token that may end here
            token = self.ids.get(seen[n - 1 - back :])
            if token is not None and self._fit(last, token):
                emitted = count + 1
                break
        else:
            raise ValueError(f"the vocabulary does not encode {seen!r}")
        ahead = [(back + 1, last, count - emitted) for back, last, count in places if seen[n - 1 - back :] in self.prefixes]
        to = self._number((seen[n - ahead[0][0] :] if ahead else b"", (*ahead, (0, token, 0))))
        self._put(key, value := to << 16 | emitted + OFFSET)
        return value

    def follow(self, raw: bytes, state: tuple) -> tuple[int, tuple]:
        """Tokens of a stretch of bytes that goes on from ``state``, read one by one, and the state after it."""
        total = 0
        for begin in range(0, len(raw), GROUP):
            if len(self.states) > self.most:
                self._forget()
            now = self._number(state)
            for byte in raw[begin : begin + GROUP]:
                key = now << 8 | byte
                at = self._slot_of(key)
                value = self.values.item(at) if self.keys.item(at) == key else self._build(key)
                total += (value & 0xFFFF) - OFFSET
                now = value >> 16
            state = self.states[now]
        return total, state

    def side_by_side(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of short stretches of bytes that begin with the first state, a byte of each at a time."""
        if len(self.states) > self.most:
            self._forget()
        order = np.argsort(-size.astype(np.int16), kind="stable")
        at, size = starts[order], size[order]
        now, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(size[0] if len(size) else 0):
            m = int(np.searchsorted(-size, -k, side="left"))
            keys = now[:m] << 8 | raw[at[:m] + k]
            slots, there = self._slots_of(keys)
            if not there.all():
                for key in np.unique(keys[~there]).tolist():
                    self._build(key)
                slots, _ = self._slots_of(keys)
            value = self.values[slots]
            total[:m] += (value & 0xFFFF) - OFFSET
            now[:m] = value >> 16
        out = np.empty_like(total)
        out[order] = total
        return out

    def counts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each stretch of bytes that begins at ``starts`` and ends where the next one begins."""
        size = np.diff(starts, append=len(raw))
        out = np.zeros(len(starts), np.int64)
        for i in np.flatnonzero(size > LOCKSTEP):
            out[i] = self.follow(raw[starts[i] : starts[i] + size[i]].tobytes(), self.first)[0]
        short = np.flatnonzero(size <= LOCKSTEP)
        ends = np.cumsum(size[short])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(GROUP, (ends[-1] if len(ends) else 0) + GROUP, GROUP)), [len(short)]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = short[a:b]
            out[some] = self.side_by_side(raw, starts[some], size[some])
        return out


# ---------------------------------------------------------------- both together


class TokenCounter:
    """The machines of one tokenizer file, built in a worker when first asked for."""

    def __init__(self, path: str, states: int = STATES):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that take blanks or ask for whole words are not compiled")
        of, special = plain_bytes(), {t.content for t in added}
        shown = {b: c for c, b in of.items()}
        vocabulary = {bytes(of[c] for c in t): i for t, i in tokenizer.get_vocab().items() if t not in special}
        model = tokenizer.model
        self.splitter = Splitter(tokenizer.pre_tokenizer.pre_tokenize_str)
        self.merger = Merger(vocabulary, lambda b: [t.id for t in model.tokenize("".join([shown[x] for x in b]))], states)
        self.added = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        owner, parts, out = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = self.added.split(text) if self.added else [text]
            out[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        at, size, totals = 0, 0, np.zeros(len(parts), np.int64)
        for k, part in enumerate(parts):
            if len(part) > SLICE:
                totals[k] = self._long(part)
            if len(part) > SLICE or size + len(part) > SLICE:
                totals[at:k] = self._together(parts[at:k])
                at, size = (k + 1 if len(part) > SLICE else k), 0
            size += len(part) + 1 if len(part) <= SLICE else 0
        totals[at:] = self._together(parts[at:])
        np.add.at(out, np.array(owner, np.int64), totals)
        return out

    def _together(self, parts: list[str]) -> np.ndarray:
        """Tokens of each of some texts, as one stream with breaks."""
        if not parts:
            return np.zeros(0, np.int64)
        joined = "\0".join([*parts, ""])
        codes, raw, at = arrays(joined)
        breaks = np.cumsum([len(p) + 1 for p in parts]) - 1
        codes[breaks] = BREAK
        begins, _ = self.splitter.beginnings(self.splitter.symbols(codes), Splitter.DONE)
        begins[breaks] = True  # so that no stretch holds a break; what is counted for these goes
        places = np.flatnonzero(begins)
        counts = self.merger.counts(raw, at[places])
        counts[np.searchsorted(places, breaks)] = 0
        return np.add.reduceat(counts, np.searchsorted(places, np.concatenate([[0], breaks[:-1] + 1])))

    def _long(self, text: str) -> int:
        """Tokens of a text that is read in slices, each of which goes on from the states after the one before."""
        total, split, merge = 0, Splitter.DONE, self.merger.first
        for begin in range(0, len(text), SLICE):
            size = min(SLICE, len(text) - begin)
            codes, raw, at = arrays(text[begin : begin + size + 3])
            begins, split = self.splitter.beginnings(self.splitter.symbols(codes)[:size], split)
            raw = raw[: at[size]]
            starts = at[np.flatnonzero(begins)]
            more, merge = self.merger.follow(raw[: starts[0] if len(starts) else len(raw)].tobytes(), merge)
            total += more
            if len(starts):
                total += int(self.merger.counts(raw[: starts[-1]], starts[:-1]).sum())
                more, merge = self.merger.follow(raw[starts[-1] :].tobytes(), self.merger.first)
                total += more
        return total


def arrays(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (three breaks follow), UTF-8 bytes, and where the bytes of each code point and of the end begin."""
    codes = np.concatenate([np.frombuffer(text.encode("utf-32-le"), np.uint32), np.full(3, BREAK, np.uint32)])
    some = codes[:-3]
    width = np.ones(len(some), np.int64)
    for least in (0x80, 0x800, 0x10000):
        width += some >= least
    return codes, np.frombuffer(text.encode(), np.uint8), np.concatenate([[0], np.cumsum(width)])


_COUNTERS: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, name: str = "n_tokens") -> DataFrame:
    """``docs`` (doc_id, text) with ``name``, the tokens of each text, and n_bytes."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = TokenCounter(tokenizer_path)
        return pd.Series(_COUNTERS[tokenizer_path].counts(texts.tolist()), dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    return pick(docs, "doc_id", "text").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias(name))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, and whether they are more than ``LIMIT``."""
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_file())
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLE_SQL: dict[str, str] = {}
