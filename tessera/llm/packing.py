"""Sum-of-squares packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import word_bpe
from tessera.llm.common import arrow_map, chunks, ship, table, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length.

    Longest first; each goes where the sum over gaps of (open bins with that gap) squared becomes smallest: into an
    open bin of gap g >= length or into a new bin. On ties the tightest gap wins, an open bin before a new one.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full bins are closed, count[0] stays 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = 0
    for i in order.tolist():
        s = int(lengths[i])
        here = count[s:capacity]
        gap = capacity
        if s < capacity and here.any():
            change = 2 * (count[: capacity - s] - here) + 2
            change[0] -= 1  # a bin that fills up leaves the sum
            change[here == 0] = 1 << 60
            k = int(change.argmin())
            if change[k] <= 2 * count[capacity - s] + 1:
                gap = s + k
        if gap == capacity:
            b, used = used, used + 1
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def _pieces(path: str, capacity: int, end_id: int | None):
    def run(batches):
        enc = word_bpe.encoder(path)
        for c in chunks(batches):
            ids, offs = enc.encode_with_end(c, end_id)
            n = -(-np.diff(offs) // capacity)
            row = np.repeat(np.arange(len(c)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(offs)[row] - start)
            raw = memoryview(ids.astype("<u4")).cast("B")
            at = ((offs[:-1][row] + start) * 4).tolist()
            crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(at, (length * 4).tolist())]
            yield table(ARROW, c.ids[row], piece.astype(np.int32), start, length, np.array(crc, np.int64))

    return run


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append the end id and cut what is longer than ``capacity``: ``doc_id, piece, start, length, ids_crc32``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, _pieces(tokenizer or word_bpe.default_path(), capacity, end_id), PIECES)


def assign(parts: DataFrame, capacity: int = 2048, group_rows: int = 65_536) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``doc_id, piece, length``.

    Pieces are dealt by hash into groups of about ``group_rows``, each packed on its own: the memory of a task is
    fixed, groups grow in number with the input, and a group wastes a few open bins at most. ``parts`` is read twice
    (once for its count), so pass a written table.
    """
    n = parts.count()
    groups = max(1, -(-n // group_rows))
    ship(parts.sparkSession)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        b, o = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["__g"].to_numpy().astype(np.int64) * (1 << 32) + b, offset=o).drop(columns="__g")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    dealt = parts.withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("__g").applyInPandas(pack, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents: one row per piece with its sequence and its place there.

    Only documents above ``capacity`` tokens are cut, into full pieces and a rest. Sequences are filled without gaps
    from offset 0. A null text is empty and becomes one piece with the end id only; rows without an id are left out;
    rows with the same id are packed one by one; an empty table gives no rows; other columns are ignored.
    """
    return assign(written(pieces(docs, capacity, tokenizer, end_id, id_col, text_col), "pieces"), capacity)
