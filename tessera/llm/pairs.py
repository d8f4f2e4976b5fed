"""Bring the texts of document pairs together without a copy of a hot text per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SALT_ROWS = 2000
#: At most so many documents count as hot, and those only from ``SALT_ROWS`` partners on.
HOT_DOCS = 5000
#: So many rows may meet in one task; below, no key is looked for that has too many.
FEW = 200_000


def join_sizes(rows: DataFrame, sizes: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``sizes`` (a row per key, with the key's number of rows in ``n``), keys without one left out.

    Keys with many rows are broadcast (``HOT_DOCS`` at most, as there are ``total`` rows in all), the others joined.
    """
    if total <= FEW:
        return rows.join(sizes, key)
    limit = max(1000, total // HOT_DOCS)
    packed = F.struct(*(c for c in sizes.columns if c != key)).alias("__s")
    marked = rows.join(F.broadcast(sizes.where(F.col("n") >= limit).select(key, packed)), key, "left")
    cold = marked.where("__s is null").drop("__s").join(sizes.where(F.col("n") < limit).select(key, packed), key)
    return marked.where("__s is not null").unionByName(cold).select(*rows.columns, "__s.*")


def side_by_side(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows ``a, b, role, text, *others`` of pairs (a, b, *others): role 0 has the text of a (b = a) and stands before
    its partners, role 1 the text of b.

    Other columns of ``docs`` follow at the end. Partners of one a come in order within a task. A hot a is salted by the number of its partners, with one copy
    of its text for each salt; the list of hot ones is broadcast and has ``HOT_DOCS`` rows at most, by their number of
    partners. The join is by sort and merge at every size, so that the plan doesn't change with it.
    """
    pairs = written(pairs, "pairs")
    others = [c for c in pairs.columns if c not in ("a", "b")]
    limit = max(SALT_ROWS, pairs.count() // HOT_DOCS)
    hot = pairs.groupBy("a").count().where(F.col("count") >= limit).select("a", F.ceil(F.col("count") / SALT_ROWS).cast("long").alias("salts"))
    numbered = pairs.join(F.broadcast(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).alias("salt"), *others)
    leaders = numbered.select("a", "salt").distinct().select("a", F.col("a").alias("b"), "salt", F.lit(0).alias("role"))
    members = leaders.unionByName(numbered.withColumn("role", F.lit(1)), allowMissingColumns=True)
    further = [c for c in docs.columns if c not in ("doc_id", "text")]
    texts = docs.select(F.col("doc_id").alias("b"), "text", *further).hint("merge")
    ordered = texts.join(members, "b").repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "b")
    return ordered.select("a", "b", "role", "text", *others, *further)
