"""Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups' roots, and a proof per row.

Everything is DataFrame and SQL functions. Rows are numbered inside their group by a range exchange; runs of 1024
neighbouring nodes become one array each, and such a block collapses its levels inside one row, by ``aggregate`` over
``transform`` over ``slice``. The roots of a group's blocks are nodes again and go through the same step until each
group has one root; the groups' roots are the nodes of one more tree. Proofs come down the same way: a block's path to
the root is joined to the block, not to its rows, and each member adds its siblings inside the block.

An array holds 1024 nodes at most, whatever the size of a group, and the number of rounds is the logarithm of the
largest group to the base 1024: two for a million rows, four for 10**12.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Levels that a block collapses; it holds two to their power nodes.
LEVELS = 10
#: Row numbers of ``monotonically_increasing_id`` inside a partition.
ROW_BITS = 33


def digest(parts: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the parts one behind the other: ``-`` for null, else UTF-8 byte count, colon, value."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to. A step without a sibling hashes the node alone."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.when(s["sibling"].isNull(), h).when(s["left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings one behind the other."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def _numbered(nodes: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``pos`` (from 0) of each row in its ``grp``, by ``order``, and the group's number of rows ``n``.

    Rows are dealt by range over group and order, so a group that holds most rows is spread like any other; only the
    numbers of rows of each group in each partition are added up.
    """
    dealt = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    rows = written(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("at", ROW_BITS))
    runs = rows.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("part").alias("run_part"), F.col("grp").alias("run_grp"), (F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("own").over(Window.partitionBy("grp")).alias("n")
    )
    return rows.join(runs, (rows.part == runs.run_part) & rows.grp.eqNullSafe(runs.run_grp)).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "run_part", "run_grp", "shift")


def _blocks(nodes: DataFrame, carried: Sequence[str], name: str) -> DataFrame:
    """Rows ``grp, block, n, members, tiers, root`` from ``grp, pos, n, node`` and carried columns.

    ``tiers`` are the levels inside the block, from its nodes up: ten where the group has more nodes than a block
    holds, else as many as lead to one node.
    """
    grouped = nodes.groupBy("grp", F.shiftright("pos", LEVELS).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "node", *carried))).alias("members"))
    steps = F.expr(f"slice(sequence(1, {LEVELS}), 1, least({LEVELS}, IF(n > 1, length(bin(n - 1)), 0)))")
    above = "transform(sequence(0, (size(element_at(t, -1)) + 1) DIV 2 - 1), i -> sha2(array_join(slice(element_at(t, -1), 2 * CAST(i AS INT) + 1, 2), ''), 256))"
    tiers = F.expr(f"aggregate(steps, array(transform(members, m -> m.node)), (t, k) -> concat(t, array({above})))")
    made = grouped.withColumn("steps", steps).withColumn("tiers", tiers).drop("steps")
    return written(made.withColumn("root", F.expr("element_at(tiers, -1)[0]")), name)


def _rise(nodes: DataFrame, carried: Sequence[str], name: str) -> list[DataFrame]:
    """Blocks of all rounds, the lowest first; in the last one each group is one block."""
    rounds = [_blocks(nodes, carried, name)]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    size = 1 << LEVELS
    while most > size:
        roots = rounds[-1].select("grp", F.col("block").alias("pos"), F.shiftright(F.col("n") + (size - 1), LEVELS).alias("n"), F.col("root").alias("node"))
        rounds.append(_blocks(roots, (), name))
        most = -(-most // size)
    return rounds


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Members of the lowest round as ``m``, each with ``path, subroot, root``. ``tops`` has ``grp, above, subroot, root``."""
    # a member's siblings inside its block, then the block's own
    inside = f"transform(slice(sequence(0, {LEVELS - 1}), 1, size(tiers) - 1), l -> named_struct('left', shiftright(i, l) % 2 = 1, 'sibling', get(tiers[l], shiftright(i, l) ^ 1)))"
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        b, t = blocks.drop("root"), tops.select(F.col("grp").alias("top_grp"), F.col("block").alias("top_block"), "above", "subroot", "root")
        joined = b.join(t, b.grp.eqNullSafe(t.top_grp) & (b.block == t.top_block))
        members = joined.select("grp", "subroot", "root", F.inline(F.expr(f"transform(members, (m, i) -> named_struct('m', m, 'path', concat({inside}, above)))")))
        tops = members.select("grp", F.col("m.pos").alias("block"), F.col("path").alias("above"), "subroot", "root")
    return members


def proofs(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """``id_col, leaf, subroot, root, path`` and the carried columns: a row for each row of ``docs``.

    ``leaf`` is the digest of ``columns``. Inside a group leaves ascend by id, then by digest; two neighbouring nodes
    become one, the last of an odd number alone. The groups' roots, in byte order of the group with null first, make
    ``root`` in the same way. ``path`` has the steps from the leaf to the root, ``left`` (the sibling stands left) and
    ``sibling`` (null where the node is alone). ``folded(leaf, path)`` is ``root``.

    Cases: nulls are values of their own, different from empty texts; a null group is a group. Rows that repeat an id
    are leaves of their own; so are rows that repeat all columns, whose paths differ while their leaves agree. Other
    columns are ignored, and names of columns don't matter. An empty table gives no rows.
    """
    carry = carry or {}
    names = [f"c{i}" for i in range(len(carry))]
    nodes = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), digest([F.col(c) for c in columns]).alias("node"), *(c.alias(n) for n, c in zip(names, carry.values())))
    # the digests are made once; the number tells rows apart that agree in all, so that any number of them is spread
    nodes = written(nodes.withColumn("row", F.monotonically_increasing_id()), "leaves")
    rounds = _rise(_numbered(nodes, ("id", "node", "row"), "numbered"), ("id", *names), "blocks")
    groups = rounds[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node"))
    upper = _rise(_numbered(groups, ("name",), "groups"), ("name",), "upper")
    none = F.array().cast("array<struct<left:boolean,sibling:string>>")
    top = upper[-1].select("grp", none.alias("above"), F.lit(None).cast("string").alias("subroot"), "root")
    tops = _descend(upper, top).select(F.col("m.name").alias("grp"), F.col("path").alias("above"), F.col("m.node").alias("subroot"), "root")
    found = _descend(rounds, tops)
    return found.select(F.col("m.id").alias(id_col), F.col("m.node").alias("leaf"), "subroot", "root", "path", *(F.col(f"m.{n}").alias(c) for n, c in zip(names, carry)))


def tampered(docs: DataFrame, columns: Sequence[str], changes: dict[str, Column], where: Column) -> Column:
    """The digest of a row after ``changes`` to some of its columns; null where ``where`` doesn't hold."""
    return F.when(where, digest([changes.get(c, F.col(c)) for c in columns]))


def checked(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", length_col: str = "n_chars", every: int = 7) -> DataFrame:
    """Proofs of all rows against a copy of the table in which some rows were tampered with.

    Where ``every`` divides the CRC-32 of the id in decimals, the tampered copy has ``length_col`` one larger (null stays
    null); its digest with the original siblings gives ``folded_root``, and ``verified`` tells whether that is the root.
    Returns ``id_col, leaf, subroot, root, proof_sha256, folded_root, verified, n_steps``; cases as in ``proofs``.
    """
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    rows = proofs(docs, columns, group_col, id_col, {"changed": tampered(docs, columns, {length_col: F.col(length_col) + 1}, hit)})
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select(id_col, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.size("path").cast("long").alias("n_steps"))
