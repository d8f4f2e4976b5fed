"""Byte-exact repeats of a fixed length by blockwise suffix sorting with a difference cover.

A suffix matters here only up to ``length`` bytes, so suffixes are windows of that length. The corpus is cut into
suffix buckets that are sorted one at a time:

1. Every window has one anchor, the leftmost position in it whose 64-byte gram has the least hash. Windows of a
   document with the same anchor and about the same distance to it form a segment. All windows of a segment hold a
   common core, whose hash is the bucket; equal windows always fall into the same bucket at the same distance.
2. Segments (not windows) are exchanged as packed digests (128-bit BLAKE2 of their bytes and place), copies within a
   task once. Segments of equal digest are equal, so all their windows repeat; a bucket with one segment has no repeat;
   only buckets with different segments need their text.
3. Those are suffix-sorted a few megabytes at a time: positions of a difference cover modulo 31 are ranked first, by
   doubling; then all suffixes are ordered by their first bytes, ties by the rank of the next cover position, so no
   comparison runs through a long common part. Neighbours that agree in all ``length`` bytes repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, chunks, merged, mix, ship, table, written

GRAM = 64
#: Distances to the anchor are cut into blocks of so many windows.
BLOCK = 112
#: Difference cover modulo 31: any two residues have a common shift into it (a perfect difference set).
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
FLUSH_BYTES = 12 << 20
SORT_BYTES = 1 << 20
#: A bucket with more different segments than this is split by its windows' whole strings, as any bucket that is too
#: large for a task has to be split by more of its suffixes.
HOT_SEGMENTS = 1024
SEGMENT = np.dtype([("core", "<u8"), ("block", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("lo", "<u4"), ("shift", "u1"), ("n", "u1"), ("more", "u1")])
HIT = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])


#: Odd base of the rolling hash and its inverse, both modulo 2**64. It chooses anchors and names buckets; what is equal
#: is decided on the bytes.
BASE = 0x2545F4914F6CDD1D
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- segments
def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        out = np.ones(m, np.uint64)
        with np.errstate(over="ignore"):
            k = 1
            while k < m:
                out[k : 2 * k] = out[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
        _POWERS[base] = have = out
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of code(data[k]) * BASE**k for k in [i, j)."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def rolled(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, from ``prefix_hash``."""
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * powers(BASE_INV, len(h))[start])


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    m, k = v, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - k :]) if width > k else m


def segments(ids: np.ndarray, data: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """Segments of all windows of some documents."""
    size = len(data)
    if size < length:
        return np.zeros(0, SEGMENT)
    h = prefix_hash(data)
    at = np.arange(size - GRAM + 1)
    bits = np.uint64(max(20, int(size).bit_length()))
    gram = rolled(h, at, at + GRAM)
    tagged = ((gram >> bits) << bits) | at.astype(np.uint64)
    anchor = (sliding_least(tagged, length - GRAM + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), np.diff(offs))[: len(anchor)]
    valid = at[: len(anchor)] + length <= offs[row + 1]
    i = np.flatnonzero(valid)
    if not len(i):
        return np.zeros(0, SEGMENT)
    anchor, row = anchor[i], row[i]
    block = (anchor - i) // BLOCK
    new = np.r_[True, (np.diff(i) > 1) | (np.diff(row) > 0) | (np.diff(anchor) != 0) | (np.diff(block) != 0)]
    first = np.flatnonzero(new)
    lo, n = i[first], np.diff(np.r_[first, len(i)])
    b, r = block[first], row[first]
    core = anchor[first] - b * BLOCK
    out = np.zeros(len(lo), SEGMENT)
    out["core"] = mix(rolled(h, core, core + length - BLOCK + 1) + b.astype(np.uint64))
    out["shift"], out["n"] = core - lo, n
    raw, blake = data.tobytes(), hashlib.blake2b
    digest = b"".join([blake(raw[x:y], digest_size=16, salt=z).digest() for x, y, z in zip(lo.tolist(), (lo + n - 1 + length).tolist(), map(bytes, np.stack([core - lo, n], 1).astype(np.uint8)))])
    out["block"], out["check"] = np.frombuffer(digest, "<u8").reshape(-1, 2).T
    out["doc"], out["lo"] = ids[r], lo - offs[r]
    return out


def hits_of(seg: np.ndarray, length: int) -> np.ndarray:
    """Merged byte ranges that the windows of some segments cover."""
    return merge_hits(seg["doc"], seg["lo"].astype(np.int64), seg["lo"].astype(np.int64) + seg["n"] - 1 + length)


def merge_hits(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(doc):
        return np.zeros(0, HIT)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    which = np.cumsum(np.r_[0, np.diff(doc) != 0])
    wide = int(end.max()) + 2
    s, e = merged(which * wide + start, which * wide + end)
    out = np.zeros(len(s), HIT)
    out["doc"] = doc[np.searchsorted(which, s // wide)]
    out["start"], out["end"] = s % wide, s % wide + e - s
    return out


def _combined(seg: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments once each (``more`` set if there are several), and the hits of the others."""
    seg = seg[np.lexsort((seg["lo"], seg["doc"], seg["check"], seg["block"], seg["core"]))]
    same = np.logical_and.reduce([seg[k][1:] == seg[k][:-1] for k in ("core", "block", "check")])
    first = np.r_[True, ~same]
    more = np.zeros(len(seg), bool)
    more[:-1] = same
    out = seg[first]
    out["more"] |= more[first]
    return out, hits_of(seg[~first], length)


def _exchange(length: int, buckets: int):
    """Rows (bucket, kind, data): packed segments (0) and hits that are certain already (1)."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])

    def flush(held):
        seg, hits = _combined(np.concatenate(held), length)
        bucket = (seg["core"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        seg, bucket = seg[order], bucket[order]
        at = np.flatnonzero(np.r_[True, np.diff(bucket) > 0])
        rows = [(int(bucket[a]), 0, seg[a:b].tobytes()) for a, b in zip(at, np.r_[at[1:], len(seg)])]
        if len(hits):
            rows.append((int(hits["doc"][0] % buckets), 1, hits.tobytes()))
        return table(schema, *map(list, zip(*rows)))

    def run(batches):
        held, size = [], 0
        for c in chunks(batches):
            s = segments(c.ids, c.data, c.offs, length)
            if len(s):
                held.append(s)
                size += s.nbytes
            if size > FLUSH_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _settle(length: int):
    """One bucket: certain hits (kind 1), and one holder of each different segment of an open core (0; 2 if hot)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = [np.frombuffer(x, HIT) for x in pdf["data"][pdf["kind"] == 1]]
        packed = [np.frombuffer(x, SEGMENT) for x in pdf["data"][pdf["kind"] == 0]]
        open_ = np.zeros(0, SEGMENT)
        hot = np.zeros(0, bool)
        if packed:
            seg = np.concatenate(packed)
            seg = seg[np.lexsort((seg["lo"], seg["doc"], seg["check"], seg["block"], seg["core"]))]
            new_core = np.r_[True, seg["core"][1:] != seg["core"][:-1]]
            new = new_core | np.r_[True, (seg["block"][1:] != seg["block"][:-1]) | (seg["check"][1:] != seg["check"][:-1])]
            block = np.cumsum(new) - 1
            count = np.bincount(block, weights=1 + seg["more"])
            hits.append(hits_of(seg[count[block] > 1], length))
            firsts = seg[new]
            core = np.cumsum(new_core)[new] - 1
            kinds = np.bincount(core)[core]
            open_, hot = firsts[kinds > 1], kinds[kinds > 1] > HOT_SEGMENTS
        h = np.concatenate(hits) if hits else np.zeros(0, HIT)
        n, m = len(h), len(open_)
        return pd.DataFrame({
            "kind": np.r_[np.ones(n, np.int32), np.where(hot, 2, 0).astype(np.int32)], "doc_id": np.r_[h["doc"], open_["doc"]],
            "start": np.r_[h["start"], open_["lo"].astype(np.int64)], "end": np.r_[h["end"], open_["lo"].astype(np.int64) + open_["n"] - 1 + length],
            "core": np.r_[np.zeros(n, np.int64), open_["core"].view(np.int64)], "shift": np.r_[np.zeros(n, np.int32), open_["shift"].astype(np.int32)],
        })

    return run


# ---------------------------------------------------------------- suffix sorting
def _word(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Eight bytes from at + k as a big-endian number."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)[at + k]
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _names(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples, least first, equal tuples equal."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_windows(data: np.ndarray, begin: np.ndarray, n: np.ndarray, shift: np.ndarray, length: int) -> np.ndarray:
    """Which windows repeat. Segment j has n[j] windows from begin[j]; its core starts shift[j] behind begin[j].

    Returns a flag per window, segment by segment. Windows can only be equal at equal distance to their cores, so
    residues are taken from the cores and equal windows have the same next cover position.
    """
    data = np.r_[data, np.zeros(64, np.uint8)]
    total = int(n.sum())
    seg = np.repeat(np.arange(len(n)), n)
    i = begin[seg] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    residue = (i - begin[seg] - shift[seg]) % PERIOD
    step = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    # 1. ranks of the cover positions, to a depth of a multiple of the period
    depth = (length - PERIOD) // PERIOD * PERIOD
    stop = begin + n - 1 + length
    span = stop - begin
    at = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
    where = np.repeat(begin, span) + at
    in_cover = np.isin((at - np.repeat(shift, span)) % PERIOD, COVER)
    pos, limit = where[in_cover], np.repeat(stop, span)[in_cover]
    index = np.full(len(data), -1, np.int64)
    index[pos] = np.arange(len(pos))
    words = [_word(data, pos, k) for k in (0, 8, 16)] + [_word(data, pos, 24) >> np.uint64(8 * (32 - PERIOD))]
    name, known = _names(*words), PERIOD
    name[pos + PERIOD > limit] = 0
    while known < depth:
        jump = min(known, depth - known)
        ok = pos + known + jump <= limit
        new = np.zeros(len(pos), np.int64)
        new[ok] = _names(name[ok], name[index[pos[ok] + jump]])
        name, known = new, known + jump
    # 2. all suffixes: first bytes, residue, rank of the next cover position, last bytes
    rank = name[index[i + step[residue]]]
    back = length - depth + PERIOD
    tail = [_word(data, i, length - back + k) for k in range(0, back - 7, 8)] + [_word(data, i, length - 8)]
    keys = [*(_word(data, i, k) for k in (0, 8, 16, 24)), residue.astype(np.uint64), rank.astype(np.uint64), *tail]
    order = np.lexsort((rank, residue, keys[0]))
    # ties of the cheap keys are runs; the others decide inside them
    tied = np.zeros(total, bool)
    eq = (rank[order][1:] == rank[order][:-1]) & (residue[order][1:] == residue[order][:-1]) & (keys[0][order][1:] == keys[0][order][:-1])
    tied[1:] |= eq
    tied[:-1] |= eq
    some = order[tied]
    out = np.zeros(total, bool)
    if len(some):
        sub = [k[some] for k in keys]
        o = np.lexsort(sub[::-1])
        same = np.ones(len(o) - 1, bool)
        for k in sub:
            same &= k[o][1:] == k[o][:-1]
        got = np.zeros(len(o), bool)
        got[1:] |= same
        got[:-1] |= same
        out[some[o[got]]] = True
    return out


def _sort_buckets(length: int):
    """Rows (core, doc_id, start, shift, bytes) in order of core: hits of the windows that repeat."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def settle(core, doc, start, shift, blobs):
        size = np.fromiter(map(len, blobs), np.int64, len(blobs))
        begin = np.cumsum(size) - size
        n = size - length + 1
        flag = repeated_windows(np.frombuffer(b"".join(blobs), np.uint8), begin, n, np.asarray(shift, np.int64), length)
        seg = np.repeat(np.arange(len(n)), n)[flag]
        at = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))[flag]
        begin_at = np.asarray(start, np.int64)[seg] + at
        h = merge_hits(np.asarray(doc, np.int64)[seg], begin_at, begin_at + length)
        return table(schema, h["doc"], h["start"], h["end"])

    def run(batches):
        held: list[list] = [[], [], [], [], []]
        size = 0
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                if size > SORT_BYTES and row[0] != held[0][-1]:
                    yield settle(*held)
                    held, size = [[], [], [], [], []], 0
                for col, v in zip(held, row):
                    col.append(v)
                size += len(row[4])
        if held[0]:
            yield settle(*held)

    return run


def _windows(length: int):
    """Rows (core, doc_id, start, shift, bytes): a row (key, doc_id, start) for each window, by the digest of its string."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64())])

    def run(batches):
        for b in batches:
            for core, doc, start, _, blob in zip(*(b.column(k).to_pylist() for k in range(5))):
                n = len(blob) - length + 1
                yield table(schema, [hashlib.blake2b(blob[i : i + length], digest_size=16).digest() for i in range(n)], np.full(n, doc), start + np.arange(n))

    return run


# ---------------------------------------------------------------- operators
def repeated_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, start, end``: byte ranges covered by a string of ``length`` bytes that starts anywhere else too.

    ``docs`` has ``doc_id, text`` with unique ids. Ranges of a document may overlap.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (16 << 20)))
    packed = arrow_map(docs, _exchange(length, buckets), "bucket int, kind int, data binary")
    schema = "kind int, doc_id long, start long, end long, core long, shift int"
    settled = written(packed.groupBy("bucket").applyInPandas(_settle(length), schema), "segments")
    certain = settled.where("kind = 1").select("doc_id", "start", "end")
    # the same rows of the same columns by id as in ``remove_repeats``, so that the texts are exchanged once for all joins
    asked = settled.where("kind <> 1").join(docs.select("doc_id", "text").hint("merge"), "doc_id")
    cut = asked.select("kind", "core", "doc_id", "start", "shift", F.expr("substring(cast(text as binary), cast(start + 1 as int), cast(end - start as int))").alias("bytes"))
    normal = cut.where("kind = 0").drop("kind").repartition("core").sortWithinPartitions("core", "doc_id", "start")
    sorted_ = arrow_map(normal, _sort_buckets(length), "doc_id long, start long, end long")
    found = certain.unionByName(sorted_)
    if not settled.where("kind = 2").isEmpty():
        windows = arrow_map(cut.where("kind = 2").drop("kind"), _windows(length), "key binary, doc_id long, start long")
        often = windows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
        found = found.unionByName(often.select("doc_id", "start", (F.col("start") + length).alias("end")))
    return found


def _removed(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
    for b in batches:
        cols: list[list] = [[] for _ in schema]
        for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist()):
            left, n = text, 0
            if spans:
                s, e = merged(np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans]))
                n = len(s)
                cut = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
                left = b"".join(text[cut[k] : cut[k + 1]] for k in range(0, len(cut), 2))
            for col, v in zip(cols, (doc, len(text), len(text) - len(left), n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace"))):
                col.append(v)
        yield table(schema, *cols)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: texts without the bytes that repeats cover.

    Every occurrence goes, the first too; ranges may start or end inside a character, whose rest then shows as a
    replacement character in ``kept`` (``kept_sha256`` is over the bytes). A null text is empty; documents shorter
    than ``length`` have no repeats; rows without an id are left out; ids have to be unique (rows that repeat an id
    must repeat its text, and don't count as a second occurrence of each other); an empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    spans = repeated_ranges(rows, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return arrow_map(rows.hint("merge").join(spans, "doc_id", "left").select("doc_id", "text", "spans"), _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
