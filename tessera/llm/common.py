"""Shared pieces of the corpus operators: scratch tables, package shipping, byte-level numpy text primitives.

Text primitives work on whole Arrow batches: a chunk is one flat ``uint8`` array with row offsets, so every
step is one numpy call over about a megabyte, never a Python loop over characters.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes that part words: space, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- session helpers
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    sc.addPyFile(target)
    sc._tessera_shipped = True


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one that ``spark.checkpoint.dir`` names.

    Where that is unset, a local temporary one if driver and executors are one process; on a cluster that is an error,
    as executors and driver don't see each other's disks.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not getattr(sc, "_tessera_scratch", None):
            sc._tessera_scratch = tempfile.mkdtemp(prefix="tessera-scratch-")
        root = sc._tessera_scratch
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the scratch folder and read it back: lineage is cut and later readers don't compute it again."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this application; call it when no frame made from them is read any more, before the
    session is stopped. (They also go when the driver's interpreter ends with the session still running.)"""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)


_WRITTEN: dict[str, list[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def text_key(text_col: str):
    """128-bit digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of a struct ``row``: what stages pack, so that no name of theirs can meet a user's."""
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def ambiguous_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Column ``id``: the ids that name different texts."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("k")).where("id is not null").groupBy("id")
    return ids.agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("id")


def ascii_lower(c):
    """Lower-case A-Z only. Pure-ASCII rows take the fast built-in path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


# ---------------------------------------------------------------- chunks
class Chunk:
    """Rows of one Arrow batch: ids, flat bytes and offsets."""

    __slots__ = ("ids", "data", "offs")

    def __init__(self, ids, data, offs):
        self.ids, self.data, self.offs = ids, data, offs

    def __len__(self):
        return len(self.ids)

    def texts(self) -> list[str]:
        raw = self.data.tobytes()
        o = self.offs.tolist()
        return [raw[o[i] : o[i + 1]].decode("utf-8", "replace") for i in range(len(self.ids))]

    def blobs(self) -> list[bytes]:
        raw = self.data.tobytes()
        o = self.offs.tolist()
        return [raw[o[i] : o[i + 1]] for i in range(len(self.ids))]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of at most ``limit`` bytes (or one row) from batches whose first columns are an id and a text.

    A null text is an empty one; rows without an id are left out, as no result could name them.
    """
    for b in batches:
        ids, text = b.column(0), b.column(1)
        if ids.null_count:
            keep = pc.is_valid(ids)
            ids, text = ids.filter(keep), text.filter(keep)
        if not len(ids):
            continue
        text = text.cast(pa.large_binary()) if not text.null_count else pc.fill_null(text.cast(pa.large_binary()), b"")
        ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        bufs = text.buffers()
        offs = np.frombuffer(bufs[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
        i = 0
        while i < len(ids):
            j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
            j = min(max(j, i + 1), len(ids))
            yield Chunk(ids[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            i = j


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans above so many bytes are hashed one by one with BLAKE2.
_LONG = 4096
_LANES = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lanes: int = 1) -> list[np.ndarray]:
    """``lanes`` independent 64-bit hashes of spans, equal for equal bytes wherever they stand.

    The length and then eight bytes at a time go through the finaliser of splitmix64, all spans together; no sum or
    polynomial of the bytes is taken, so no family of texts collides by its structure.
    """
    n = end - start
    long_ = np.flatnonzero(n > _LONG)
    if len(long_):
        n = np.where(n > _LONG, 0, n)
    words_ = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    with np.errstate(over="ignore"):
        out = [mix(n.astype(np.uint64) * MULT + k) for k in _LANES[:lanes]]
    now, at, left, who = out, start, n, None
    while True:
        block = words_[at] & _FIRST[np.minimum(left, 8)]
        now = [mix(h ^ block) for h in now]
        if who is None:
            out = now
        else:
            for o, h in zip(out, now):
                o[who] = h
        go = np.flatnonzero(left > 8)
        if not len(go):
            break
        who = go if who is None else who[go]
        at, left, now = at[go] + 8, left[go] - 8, [h[go] for h in now]
    for i in long_.tolist():
        digest = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8 * lanes).digest(), np.uint64)
        for o, d in zip(out, digest):
            o[i] = d
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words don't cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begin = offs[:-1][np.diff(offs) > 0]
    first[begin] = inside[begin]
    last[begin[1:] - 1] = inside[begin[1:] - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    at = np.flatnonzero(new)
    return s[at], e[np.r_[at[1:] - 1, len(e) - 1]]


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
