"""Token-id files: Parquet with one list column of ids per document, in ascending id order.

Layout: range-partitioned and sorted by id, so that row-group and page statistics on ``doc_id`` are tight and a reader
of a few documents opens few pages; ids are dictionary-encoded int32 lists (delta encoding beyond the dictionary's
size), metadata columns stand beside them and are read without touching the ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm import word_bpe
from tessera.llm.common import arrow_map, chunks, table

SCHEMA = "doc_id long, n_tokens long, part int, part_start long, tokens array<int>"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("tokens", pa.list_(pa.int32()))])
CRC = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("ids_crc32", pa.int64())])


def _encode(path: str, end_id: int | None):
    def run(batches):
        from pyspark import TaskContext

        enc, part, start = word_bpe.encoder(path), TaskContext.get().partitionId(), 0
        for c in chunks(batches):
            ids, offs = enc.encode_with_end(c, end_id)
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.view(np.int32), pa.int32()))
            yield table(ARROW, c.ids, np.diff(offs), np.full(len(c), part, np.int32), start + offs[:-1], lists)
            start += int(offs[-1])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 64 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode every whole text and write the files to ``out``.

    Texts, not ids, go through the one range shuffle (they are the smaller). Running starts are kept per part, which
    one task writes from first to last row. Null texts are empty (only the end id is written), rows without an id are
    left out, an empty table gives a folder without rows, repeated ids are written one after another; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.where("doc_id is not null").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (
        arrow_map(ordered, _encode(tokenizer or word_bpe.default_path(), end_id), SCHEMA)
        .write.option("compression", "snappy")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(out)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens`` without reading any id."""
    return with_start(spark.read.schema(SCHEMA).parquet(path).select("doc_id", "n_tokens", "part", "part_start"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, tokens``; a given (short) list of ids is pushed down to row groups and pages."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return (df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))).select("doc_id", "tokens")


def with_start(df: DataFrame) -> DataFrame:
    """Replace (part, part_start) by the global start. One row a part is all that is ordered globally."""
    sums = df.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = sums.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__before"))
    return df.join(before, "part").withColumn("start", F.col("__before") + F.col("part_start")).drop("part", "part_start", "__before")


def _crc(batches):
    for b in batches:
        ids, offs = b.column("tokens").flatten(), b.column("tokens").offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        at = ((offs - offs[0]).astype(np.int64) * 4).tolist()
        crc = [zlib.crc32(raw[s:e]) for s, e in zip(at, at[1:])]
        yield table(CRC, b.column("doc_id"), b.column("n_tokens"), b.column("part"), b.column("part_start"), np.asarray(crc, np.int64))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, n_tokens, ids_crc32, start``."""
    df = spark.read.schema(SCHEMA).parquet(path)
    with_crc = arrow_map(df, _crc, "doc_id long, n_tokens long, part int, part_start long, ids_crc32 long")
    sums = df.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = sums.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__before"))
    return with_crc.join(before, "part").select("doc_id", (F.col("__before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
