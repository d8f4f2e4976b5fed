"""Exact dedup by a 128-bit content hash with a byte comparison, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, unpacked, written


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fold_case: bool = True) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are first aggregated by (128-bit hash, text): grouping by the text itself compares the bytes, so rows whose
    hashes collide stay apart, and copies collapse in the map-side combine, so a group that holds a third of all rows
    reaches a reducer as one row per task. Rows then find their group by hash and SHA-256 (a sort-merge join on small
    keys whose hot partitions adaptive execution splits); two texts that agree in both would stop the query.

    Cases: a null text is the empty text. ``keep`` is ``min`` or ``max`` of the ids in a group. Rows that repeat an id
    and its text count one by one in ``group_size`` and are all marked ``kept`` if their id is kept. A null id is
    kept only if its group has no other id. An empty table gives an empty result; other columns are ignored.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), (ascii_lower(text) if fold_case else text).alias("__t"))
    hashed = rows.select("__id", "__t", F.unhex(F.md5("__t")).alias("__h"))
    texts = hashed.groupBy("__h", "__t").agg(pick("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    groups = (
        texts.select("__h", F.sha2("__t", 256).alias("__s"), "__keep", "__n")
        .groupBy("__h", "__s")
        .agg(F.min("__keep").alias("keep_id"), F.sum("__n").alias("group_size"), F.count(F.lit(1)).alias("__texts"))
        .select(F.concat("__h", F.unhex("__s")).alias("__k"), "keep_id", F.when(F.col("__texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts agree in both hashes")).cast("bigint")).alias("group_size"))
    )
    members = hashed.select("__id", F.sha2("__t", 256).alias("text_sha256"), "__h").select("__id", "text_sha256", F.concat("__h", F.unhex("text_sha256")).alias("__k"))
    return members.join(groups, "__k").select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True) -> DataFrame:
    """The input with one row of each group of equal texts, one with the smallest id; all columns stay.

    Rows are matched by id and text together, so rows that repeat an id with different texts are different documents.
    Rows that repeat both go down to one (which one is open). A null text is the empty text. A row without an id stays
    only if no row with an id has its text. An empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(ascii_lower(text) if fold_case else text, 256))
    rows = exact_groups(docs, id_col, text_col, "min", fold_case).groupBy(F.col(id_col).alias("__i"), F.unhex("text_sha256").alias("__s"), "kept").agg(F.count(F.lit(1)).alias("__n"))
    others = written(rows.where("not kept or __n > 1"), "copies")  # what is dropped, and what stays once of several
    keyed = docs.select(F.col(id_col).alias("id"), sha.alias("sha"), F.struct("*").alias("row"))

    def same(t: DataFrame):
        return F.col("id").eqNullSafe(t["__i"]) & (F.col("sha") == t["__s"])

    several = others.where("kept").select("__i", "__s")
    once = keyed.join(several, same(several), "left_semi").dropDuplicates(["id", "sha"])
    gone = others.select("__i", "__s")
    return unpacked(keyed.join(gone, same(gone), "left_anti").unionByName(once), docs)
