"""MPEG transport streams in a column: multiplex, parse, check and reassemble.

``encode_streams`` multiplexes a binary column as one program with one
elementary stream of 8-bit samples; ``parse_streams`` reads any such column:
program association and map tables (with their CRC), continuity counters,
packetised elementary packets with presentation times, random-access points, for
every stream of every program.  Counters are checked on the tables' pids too; a
packet that is sent twice counts once, and a break that a packet announces is none.

The rows are handled one by one in Arrow batches, so memory is that of a batch.
Defined results: a null payload counts as empty; bytes that are not a transport
stream give a null payload and an error text instead of failing the job; where
packets are lost, what is left of the payload comes with an error text; extra
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import Scratch, bound_batches, pick, table

PACKET, PMT_PID, ES_PID = 188, 0x1000, 0x0101
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # PES packets with private data
CLOCK, SAMPLE_RATE = 90_000, 8_000
UNIT, RAP_EVERY = 8_192, 4  # bytes of an access unit; access units from one random-access point to the next


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program-specific information; 0 over a section with its CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A packet without its counter that holds one section."""
    length = 5 + len(body) + 4
    section = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    section += section_crc(section).to_bytes(4, "big")
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


PAT = _section(0, 0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
PMT = _section(PMT_PID, 0x02, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 255, 0x01 | pts << 1 & 0xFE])


def encode(payload: bytes) -> bytes:
    """The transport stream of a payload; tables are repeated before every random-access point."""
    out, counter, tables = [], 0, 0
    for i in range(0, max(len(payload), 1), UNIT):
        data = payload[i : i + UNIT]
        pts = i * CLOCK // SAMPLE_RATE % (1 << 33)
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        rap, at = i // UNIT % RAP_EVERY == 0, 0
        if rap:
            for t in (PAT, PMT):
                out.append(t[:3] + bytes([0x10 | tables & 15]) + t[4:])
            tables += 1
        while at < len(pes):
            field = b""
            if rap and not at:  # random access and the clock, whose base is the time stamp
                field = bytes([0x50]) + (pts << 15 | 0x7E00).to_bytes(6, "big")
            room = 184 - (len(field) + 1 if field else 0)
            left = len(pes) - at
            if left >= room + 184 and not field:
                n = left // 184
                block = np.empty((n, PACKET), np.uint8)
                block[:, 0], block[:, 1], block[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
                block[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
                if not at:
                    block[0, 1] |= 0x40
                block[:, 4:] = np.frombuffer(pes, np.uint8, n * 184, at).reshape(n, 184)
                out.append(block.tobytes())
                at, counter = at + n * 184, counter + n
                continue
            if left < room:
                if not field:
                    field = b"\0" if room - left > 1 else None
                lack = 184 - left - (1 + len(field) if field is not None else 1)
                field = (field or b"") + b"\xff" * lack
                adapt = bytes([len(field)]) + field
            else:
                adapt = bytes([len(field)]) + field if field else b""
            take = 184 - len(adapt)
            head = bytes([0x47, (0 if at else 0x40) | ES_PID >> 8, ES_PID & 255, (0x30 if adapt else 0x10) | counter & 15])
            out.append(head + adapt + pes[at : at + take])
            at, counter = at + take, counter + 1
    return b"".join(out)


def _sections(packets: np.ndarray, skip: np.ndarray, rows: np.ndarray, of: int) -> list[bytes]:
    """The sections of the table with pid ``of``, each number once, put together from as many packets as they take."""
    found: dict[int, bytes] = {}
    raw = b""
    for r in rows:
        body = packets[r].tobytes()[skip[r] :]
        if packets[r, 1] & 0x40:
            raw = body[1 + body[0] :]
        elif raw:
            raw += body
        while len(raw) >= 3 and raw[0] != 0xFF and len(raw) >= (n := 3 + ((raw[1] & 15) << 8 | raw[2])):
            section, raw = raw[:n], raw[n:]
            if section_crc(section):
                raise ValueError(f"bad CRC in the table with pid {of}")
            found.setdefault(section[6], section)
            if len(found) > section[7]:
                return [found[k] for k in sorted(found)]
    raise ValueError(f"no whole table with pid {of}")


def _programs(packets: np.ndarray, skip: np.ndarray, by_pid) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(number, pid of its table, [(elementary pid, stream type)]) of every program."""
    out = []
    for pat in _sections(packets, skip, by_pid(0), 0):
        for at in range(8, len(pat) - 4, 4):
            number, table = pat[at] << 8 | pat[at + 1], (pat[at + 2] & 31) << 8 | pat[at + 3]
            if not number:  # network information
                continue
            streams = []
            for pmt in _sections(packets, skip, by_pid(table), table):
                p = 12 + ((pmt[10] & 15) << 8 | pmt[11])
                while p < len(pmt) - 4:
                    streams.append(((pmt[p + 1] & 31) << 8 | pmt[p + 2], pmt[p]))
                    p += 5 + ((pmt[p + 3] & 15) << 8 | pmt[p + 4])
            out.append((number, table, streams))
    if not any(streams for _, _, streams in out):
        raise ValueError("no program with a stream")
    return out


def _continuity(packets: np.ndarray) -> tuple[np.ndarray, int]:
    """(which packets of one pid to keep, how often the counter breaks).

    A packet sent twice counts once; the counter may break where the packet says so.
    """
    c = (packets[:, 3] & 15).astype(np.int32)
    step = np.diff(c) % 16
    twice = np.zeros(len(c), bool)
    same = step == 0
    if same.any():  # the clock may differ between the two
        twice[1:] = same & (packets[1:, :4] == packets[:-1, :4]).all(1) & (packets[1:, 12:] == packets[:-1, 12:]).all(1)
    told = (packets[1:, 3] & 0x20 != 0) & (packets[1:, 4] > 0) & (packets[1:, 5] & 0x80 != 0)
    return ~twice, int(((step != 1) & ~twice[1:] & ~told).sum())


def _reassemble(packets: np.ndarray) -> tuple[bytes, list[tuple[int | None, int, bool]], int]:
    """(payload, [(time stamp, size, random access)], units cut short) of an elementary stream's packets."""
    adapted = packets[:, 3] & 0x20 != 0
    skip = np.where(adapted, packets[:, 4].astype(np.int32) + 5, 4)
    access = adapted & (packets[:, 4] > 0) & (packets[:, 5] & 0x40 != 0)
    stream = packets[np.arange(PACKET)[None, :] >= skip[:, None]].tobytes()
    ends = np.cumsum(PACKET - skip)
    units, parts, short = [], [], 0
    starts = np.flatnonzero(packets[:, 1] & 0x40)
    for row, following in zip(starts, [*starts[1:], len(packets)], strict=True):
        at, last = int(ends[row - 1]) if row else 0, int(ends[following - 1])
        if stream[at : at + 3] != b"\0\0\1":
            raise ValueError("no start code at the start of an elementary packet")
        size = int.from_bytes(stream[at + 4 : at + 6], "big")
        end = at + 6 + size if size else last  # 0: up to the next one
        short += end > last
        p = stream[at + 9 : at + 14]
        pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1 if stream[at + 7] & 0x80 else None
        data = stream[at + 9 + stream[at + 8] : min(end, last)]
        units.append((pts, len(data), bool(access[row])))
        parts.append(data)
    return b"".join(parts), units, short


def parse(media: bytes) -> dict:
    """What a stream holds: programs, packets, cc_errors over all its pids, lost (packets or bytes), and of the first
    elementary stream payload, units [(pts, size, random access)] and stream_type; ``streams`` has (pid, payload, units) of all."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (packets[:, 1] & 31).astype(np.int32) << 8 | packets[:, 2]
    loaded = packets[:, 3] & 0x10 != 0  # only packets with payload count on
    skip = np.where(packets[:, 3] & 0x20 != 0, packets[:, 4].astype(np.int32) + 5, 4)
    kept: dict[int, np.ndarray] = {}
    errors = 0

    def by_pid(p: int) -> np.ndarray:
        nonlocal errors
        if p not in kept:
            rows = np.flatnonzero((pid == p) & loaded)
            keep, breaks = _continuity(packets[rows]) if len(rows) else (np.zeros(0, bool), 0)
            kept[p] = rows[keep]
            errors += breaks
        return kept[p]

    programs = _programs(packets, skip, by_pid)
    streams, cut = [], 0
    for _, _, listed in programs:
        for es, kind in listed:
            rows = by_pid(es)
            if len(rows):
                payload, units, short = _reassemble(packets[rows])
                streams.append((es, kind, payload, units))
                cut += short
    if not streams:
        raise ValueError("no elementary packets")
    _, kind, payload, units = streams[0]
    return {
        "payload": payload, "units": units, "packets": len(packets), "cc_errors": errors, "lost": errors + cut, "stream_type": kind,
        "programs": programs, "streams": [(es, data, stamps) for es, _, data, stamps in streams],
    }


UNITS = T.ArrayType(T.StructType([T.StructField("pts", T.LongType()), T.StructField("size", T.LongType()), T.StructField("random_access", T.BooleanType())]))
STREAMS = T.ArrayType(T.StructType([T.StructField("pid", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("units", UNITS)]))
PARSED = [
    T.StructField("read_payload", T.BinaryType()), T.StructField("units", UNITS), T.StructField("packets", T.LongType()),
    T.StructField("cc_errors", T.LongType()), T.StructField("stream_type", T.LongType()), T.StructField("streams", STREAMS), T.StructField("error", T.StringType()),
]


def encode_streams(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``df`` with the binary column ``payload`` replaced by its transport stream ``media``."""
    kept = [f for f in df.schema.fields if f.name not in (payload, media)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.drop(columns=[c for c in (payload, media) if c in x]).assign(**{media: [encode(bytes(p or b"")) for p in x[payload]]})

    return df.mapInPandas(run, T.StructType([*kept, T.StructField(media, T.BinaryType())]))


def parse_streams(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with what its streams hold: read_payload, units, packets, cc_errors, stream_type, streams, error.

    Its other columns stay, but for any of these names, which are replaced; repeated rows stay, and an empty table gives an
    empty result.

    ``streams`` lists every elementary stream where there are several, else it is null.
    """
    new = {f.name for f in PARSED}
    kept = [f for f in df.schema.fields if f.name not in new]

    def one(raw) -> tuple:
        try:
            x = parse(bytes(raw or b""))
        except (ValueError, IndexError) as e:
            return None, None, None, None, None, None, str(e)
        stamps = lambda units: [{"pts": a, "size": b, "random_access": c} for a, b, c in units]
        several = [{"pid": p, "payload": d, "units": stamps(u)} for p, d, u in x["streams"]] if len(x["streams"]) > 1 else None
        error = "packets are lost, the payload may be incomplete" if x["lost"] else None
        return x["payload"], stamps(x["units"]), x["packets"], x["cc_errors"], x["stream_type"], several, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [one(m) for m in x[media]]
            out = x[[f.name for f in kept]].copy()
            for i, f in enumerate(PARSED):
                out[f.name] = pd.Series([row[i] for row in found], index=x.index, dtype=object)
            yield out

    return df.mapInPandas(run, T.StructType([*kept, *PARSED]))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stream of 8-bit samples, read back from its stored bytes."""
    bound_batches(spark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    pad = F.greatest(F.lit(64), F.ceil(F.octet_length(text) / 64).cast("int") * 64) - F.octet_length(text)
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.concat(text, _zeros(pad)).alias("payload")
    )
    # the media column is stored, and what is parsed is what the store gives back
    read = parse_streams(Scratch(spark).keep(encode_streams(docs)))
    payload = F.col("read_payload")
    units = F.col("units")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(read_payload, octet_length(read_payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("units="), F.size(units)),
            F.concat(F.lit("rap="), F.size(F.filter(units, lambda u: u.random_access))),
            F.concat(F.lit("first_pts="), F.element_at(units, 1).pts),
            F.concat(F.lit("last_pts="), F.element_at(units, -1).pts),
            F.concat(F.lit("packets="), F.col("packets")),
            F.concat(F.lit("cc_errors="), F.col("cc_errors")),
        ).alias("feature"),
        "units",
        "error",
    )


def _zeros(n):
    """A binary column of ``n`` zero bytes (n from 0 to 64)."""
    return F.unhex(F.repeat(F.lit("00"), n))


QUERIES = {"op10_media": op10_media}
ORACLE_SQL: dict[str, str] = {}
