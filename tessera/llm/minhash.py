"""Near-duplicate documents: b-bit MinHash signatures, band candidates, exact confirmation on full shingle sets.

One pass gives each document its distinct shingle count, a 128-bit hash of its set, band keys and two low bits of
every minimum, packed into eight longs. Documents of equal sets become one class. In every band bucket each class is
paired with the bucket's least class only; a pair whose collision-corrected estimate, from bit counts, is at least
``FAMILY`` puts both into one family. Similar documents share about a dozen buckets, so they meet in one family; inside
a family all links are found on the full sets through an inverted index, block against block, and no pair of documents
is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TO_LOWER, Chunk, ambiguous_ids, arrow_map, chunks, mix, span_hash, table, unpacked, words, written
from tessera.llm.components import components
from tessera.llm.pairs import join_sizes, side_by_side

BANDS, ROWS = 48, 6
SIGNATURE = 256  # minima that give bits; the first of BANDS * ROWS = 288
BITS = 2
#: Estimated similarity to a bucket's least class from which on a class belongs to its family.
FAMILY = 0.4
#: Families above these sizes are compared block by block.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 1_000_000

_RNG = np.random.default_rng(7)
MULTIPLIERS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
ADDENDS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
WORD_CODES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), *((f"b{i}", pa.int64()) for i in range(8)), ("bands", pa.list_(pa.int64()))])


def shingles(c: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of a chunk's rows, in order, and row offsets; not made distinct.

    A row with fewer words than ``size`` gives its whole sequence as one shingle, a row without words none.
    """
    data = TO_LOWER[c.data]
    start, end, row = words(data, c.offs)
    (w,) = span_hash(data, start, end)
    n = np.bincount(row, minlength=len(c))
    first = np.r_[0, np.cumsum(n)][:-1]
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(w) - size + 1), np.uint64)
        for k in range(size):
            full += w[k : k + len(full)] * WORD_CODES[k]
        inside = row[: len(full)] == row[size - 1 :] if len(full) else np.zeros(0, bool)
        h = [mix(full[inside])]
        at = [row[: len(full)][inside]]
        for i in np.flatnonzero((n > 0) & (n < size)):
            h.append(mix((w[first[i] : first[i] + n[i]] * WORD_CODES[: n[i]]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(n[i])))
            at.append(np.array([i]))
    h, at = np.concatenate(h), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return h[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(c)))]


def _signatures(size: int):
    def run(batches):
        for c in chunks(batches):
            h, offs = shingles(c, size)
            n, s = np.zeros(len(c), np.int64), np.zeros((2, len(c)), np.uint64)
            for i in np.flatnonzero(np.diff(offs)):
                u = np.unique(h[offs[i] : offs[i + 1]])
                n[i] = len(u)
                s[0, i], s[1, i] = mix(u).sum(dtype=np.uint64), mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            has = np.flatnonzero(n)
            minima = np.zeros((BANDS * ROWS, len(has)), np.uint32)
            if len(has):
                x, at = (h >> np.uint64(32)).astype(np.uint32), offs[:-1][has]
                y = np.empty_like(x)
                for j in range(BANDS * ROWS):
                    np.multiply(x, MULTIPLIERS[j], out=y)
                    np.add(y, ADDENDS[j], out=y)
                    minima[j] = np.minimum.reduceat(y, at)
            with np.errstate(over="ignore"):
                keys = np.zeros((BANDS, len(has)), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * WORD_CODES[-1]
                for r in range(ROWS):
                    keys = mix(keys + minima[r::ROWS].astype(np.uint64) * WORD_CODES[r])
            bits = np.zeros((8, len(c)), np.int64)
            for p in range(BITS):
                plane = np.packbits(((minima[:SIGNATURE] >> np.uint32(p)) & 1).astype(np.uint8).T, axis=1) if len(has) else np.zeros((0, 32), np.uint8)
                bits[4 * p : 4 * p + 4, has] = np.ascontiguousarray(plane).view(np.int64).reshape(len(has), 4).T
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))], pa.int32()), pa.array(np.ascontiguousarray(keys.T).ravel().view(np.int64)))
            yield table(ARROW, c.ids, n, s[0].view(np.int64), s[1].view(np.int64), *bits, lists)

    return run


def signatures(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n long, s1 long, s2 long, " + ", ".join(f"b{i} long" for i in range(8)) + ", bands array<long>"
    return arrow_map(rows, _signatures(shingle_words), schema)


def estimate(a: str, b: str):
    """Collision-corrected similarity from the packed bits of two aliases."""
    agree = sum(F.bit_count(F.bitwise_not((F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))).bitwiseOR(F.col(f"{a}.b{i + 4}").bitwiseXOR(F.col(f"{b}.b{i + 4}"))))) for i in range(4))
    chance = 2.0**-BITS
    return (agree / F.lit(float(SIGNATURE)) - F.lit(chance)) / F.lit(1 - chance)


def _related(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate makes them members of one family."""
    bits = [f"b{i}" for i in range(8)]
    left = reps.select(F.col("doc_id").alias("a"), *bits).alias("l")
    right = reps.select(F.col("doc_id").alias("b"), *bits).alias("r")
    return pairs.join(left, "a").join(right, "b").where(estimate("l", "r") >= FAMILY).select("a", "b")


def joined(sets: list[np.ndarray], ids: list[int], sides: list[int], percent: int, one_block: bool) -> list[tuple[int, int]]:
    """Links that join the documents of one block pair: a spanning forest of all pairs that reach the threshold.

    Intersections are counted through postings of the shingles that several documents have.
    """
    g = len(sets)
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(g), size)
    order = np.argsort(np.concatenate(sets), kind="stable") if size.sum() else np.zeros(0, np.int64)
    h = np.concatenate(sets)[order] if size.sum() else np.zeros(0, np.uint64)
    new = np.r_[True, h[1:] != h[:-1]][: len(h)]
    run = np.cumsum(new) - 1
    length = np.bincount(run, minlength=0)
    first = np.cumsum(length) - length
    owners = owner[order]
    shared = length[run] > 1
    # postings of each document's shared shingles: (first place, number)
    mine = owners[shared]
    by_doc = np.argsort(mine, kind="stable")
    runs_by_doc = run[shared][by_doc]
    until = np.cumsum(np.bincount(mine, minlength=g))
    side, label, links = np.array(sides), np.arange(g), []
    for x in range(g):
        r = runs_by_doc[until[x - 1] if x else 0 : until[x]]
        if not len(r):
            continue
        n = length[r]
        at = np.arange(int(n.sum())) + np.repeat(first[r] - (np.cumsum(n) - n), n)
        both = np.bincount(owners[at], minlength=g)
        hit = 100 * both >= percent * (size + size[x] - both)
        hit[: x + 1] = False
        if not one_block:
            hit &= side != side[x]
        hit &= label != label[x]
        for y in np.flatnonzero(hit).tolist():
            if label[y] != label[x]:
                links.append((ids[x], ids[y]))
                label[label == label[y]] = label[x]
    return links


def _compare(size: int, percent: int):
    """Rows (family, i, j, doc_id, block, text) in order of (family, i, j): links of each block pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        now, sets, ids, sides = None, [], [], []

        def finish():
            found = joined(sets, ids, sides, percent, now[1] == now[2]) if len(ids) > 1 else []
            return table(schema, [a for a, _ in found], [b for _, b in found])

        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))))
            at = 0
            for c in chunks([pa.RecordBatch.from_arrays([batch.column(3), batch.column(5)], names=["d", "t"])]):
                h, offs = shingles(c, size)
                for i, doc in enumerate(c.ids.tolist()):
                    if key[at][:3] != now:
                        if now is not None:
                            yield finish()
                        now, sets, ids, sides = key[at][:3], [], [], []
                    sets.append(np.unique(h[offs[i] : offs[i + 1]]))
                    ids.append(doc)
                    sides.append(key[at][3])
                    at += 1
        if now is not None:
            yield finish()

    return run


def _confirm(size: int, percent: int):
    """Rows (a, b, role, text) of ``side_by_side``: the pairs that are links, on their full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        leader, own = None, None
        for batch in batches:
            at, out = 0, [[], []]
            a, role = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for c in chunks([pa.RecordBatch.from_arrays([batch.column(1), batch.column(3)], names=["b", "t"])]):
                h, offs = shingles(c, size)
                for i, doc in enumerate(c.ids.tolist()):
                    mine, k = np.unique(h[offs[i] : offs[i + 1]]), at + i
                    if role[k] == 0:
                        leader, own = a[k], mine
                        continue
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if a[k] == leader and both and 100 * both >= percent * (len(own) + len(mine) - both):
                        out[0].append(leader)
                        out[1].append(doc)
                at += len(c)
            yield table(schema, *out)

    return run


def _blocks(n: str, shingles_: str):
    return F.greatest(F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(shingles_) / BLOCK_SHINGLES), F.lit(1)).cast("long")


def family_links(families: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is similar in each family. ``families`` has (node, component).

    A family of one block is compared as it is. In a larger one every member is first held against the family's least
    document on full sets; those that are links make one class with it, and only the others are compared, in blocks,
    with each other and with the members of that class. So a page that was copied a million times with small changes
    costs one comparison a copy. Each block pair is a group of its own with bounded memory.
    """
    members = reps.select("doc_id", F.col("n").alias("shingles")).join(families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    members = written(members, "members")
    total = members.count()
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("all")).withColumn("blocks", _blocks("n", "all"))
    sized = join_sizes(members, sizes, "family", total)
    small = sized.where("blocks = 1").select("family", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "doc_id", F.lit(0).cast("long").alias("block"))
    large = written(sized.where("blocks > 1").select("family", "doc_id", "shingles"), "large")
    found = None
    dealt = small
    if not large.isEmpty():
        star = large.where("doc_id <> family").select(F.col("family").alias("a"), F.col("doc_id").alias("b"))
        found = written(arrow_map(side_by_side(star, docs), _confirm(size, percent), "a long, b long"), "confirmed")
        near = large.join(found.select(F.col("b").alias("doc_id")), "doc_id", "left_semi").unionByName(large.where("doc_id = family").select("doc_id", "family", "shingles"))
        rest = large.where("doc_id <> family").join(found.select(F.col("b").alias("doc_id")), "doc_id", "left_anti")
        one = F.when(F.col("far"), 1).otherwise(0)
        both = written(near.select("family", "doc_id", "shingles", F.lit(False).alias("far")).unionByName(rest.select("family", "doc_id", "shingles", F.lit(True).alias("far"))), "sides")
        counted = both.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum(one).alias("n1"), F.sum(one * F.col("shingles")).alias("s1"), F.sum(1 - one).alias("n0"), F.sum((1 - one) * F.col("shingles")).alias("s0")).where("n1 > 0")
        counted = counted.select("family", "n", _blocks("n1", "s1").alias("b1"), _blocks("n0", "s0").alias("b0"))
        placed = join_sizes(both, counted, "family", total).withColumn("block", F.when(F.col("far"), F.pmod(F.xxhash64("doc_id"), "b1")).otherwise(F.col("b1") + F.pmod(F.xxhash64("doc_id"), "b0")))
        # the others meet all blocks, those of the class meet the others' blocks only
        meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("far"), F.col("b1") + F.col("b0")).otherwise(F.col("b1")) - 1)
        blocks = placed.select("family", "doc_id", "block", F.explode(meets).alias("k")).select("family", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "doc_id", "block")
        dealt = small.unionByName(blocks)
    rows = docs.select("doc_id", "text").hint("merge").join(dealt, "doc_id").select("family", "i", "j", "doc_id", "block", "text")
    ordered = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "doc_id")
    links = arrow_map(ordered, _compare(size, percent), "a long, b long")
    return links if found is None else links.unionByName(found)


def near_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of word shingles; A-Z count as a-z.
    ``component_id`` is the smallest id reachable over links. A pair at exactly 0.8 shares no band with a probability
    of 5e-7 (``BANDS`` times ``ROWS`` minima). A document with fewer words than a shingle has its whole sequence as its one shingle. Null, empty and
    blank texts have no shingles and are linked with nothing. Rows without an id are left out; rows that repeat an id
    count as one document when links are made (ids should name one text) and each give a row; an empty table gives
    no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sigs = written(signatures(rows, shingle_words), "signatures")
    classes = sigs.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    reps = written(sigs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "reps")
    member = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = member.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "a")
    shared = member.join(buckets, "key").select("a", F.col("doc_id").alias("b"))
    families = components(_related(shared.where("a <> b").select("a", "b").distinct(), reps), "a", "b")
    comp = components(family_links(written(families, "families"), reps, rows, shingle_words, percent), "a", "b")
    labels = sigs.select("doc_id", "n", "s1", "s2").join(classes.select("s1", "s2", F.col("n").alias("__n"), "rep"), ["s1", "s2"], "left").where("n = 0 or n = __n")
    out = labels.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")).join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one document of each group, the one with the smallest id; all columns stay.

    Rows without an id, and rows whose id names different texts, are not compared and stay. Rows that repeat an id and
    its text stay or go together. Null, empty and blank texts stay; an empty table stays empty.
    """
    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    certain = packed.select("id", "text").join(ambiguous_ids(docs, id_col, text_col), "id", "left_anti")
    dropped = near_groups(certain, shingle_words, percent, "id", "text").where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    return unpacked(packed.select("id", "row").join(dropped, "id", "left_anti"), docs)
