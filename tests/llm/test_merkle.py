"""The Merkle manifest against a tree built by hand, with groups of one block and of several rounds of blocks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, node int, row string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H("".join(x[i : i + 2])) for i in range(0, len(x), 2)])
    return levels


def path(levels, i):
    out = []
    for x in levels[:-1]:
        out.append((bool(i & 1), x[i ^ 1] if i ^ 1 < len(x) else None))
        i >>= 1
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top, out = tree([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for left, s in steps:
                h = H(h if s is None else s + h if left else h + s)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H("".join(s for _, s in steps if s)), h, h == top[-1][0], len(steps)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    out = [(i, rng.choice(["a", None, "b:1"]), rng.choice(["en", "en", "en", "de", "Ä", None, ""]), rng.choice([5, None]), f"text {i}", "x", i, None) for i in range(230)]
    out += [(7, "s", "en", 1, "again", None, 0, "y")] * 60  # an id that many rows have, all alike
    out += [(None, None, None, None, None, None, None, None), (999, "s", "lone", 3, "é" * 3, None, None, None), (1000, "s", "fr", None, "", None, None, None), (1001, "s", "fr", 2, None, None, None, None)]
    return out + [(10**12, "s", "fr", 10**10, "long " * 40_000, None, None, None)]


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_against_a_tree(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    got = merkle.checked(spark.createDataFrame(rows(), SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows())


def test_small_tables(spark):
    one = spark.createDataFrame([(14, "s", "en", 3, "abc", None, None, None)], SCHEMA)
    (r,) = merkle.checked(one).collect()
    assert r.leaf == leaf((14, "s", "en", 3, "abc")) and (r.root, r.n_steps, r.proof_sha256) == (r.leaf, 0, H(""))
    assert merkle.checked(one.limit(0)).count() == 0
    twice = merkle.checked(one.union(one)).collect()
    assert [r.root for r in twice] == [H(2 * leaf((14, "s", "en", 3, "abc")))] * 2


def test_a_proof_finds_any_change(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = merkle.proofs(docs, carry={"other": merkle.digest([F.lit("x")])})
    wrong = kept.select(merkle.folded(F.col("other"), F.col("path")).alias("f"), merkle.folded(F.col("leaf"), F.col("path")).alias("g"), "root")
    assert wrong.where("f = root").count() == 0 and wrong.where("g <> root").count() == 0
    plain = merkle.proofs(docs.withColumnRenamed("doc_id", "path").withColumnRenamed("lang", "leaf"), ("path", "source", "leaf", "n_chars", "text"), "leaf", "path")
    assert sorted(str(r[1]) for r in plain.toDF("a", "b", "c", "d", "e").select("d", "b").collect()) == sorted(map(leaf, rows()))


def test_query_and_sql_agree(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.ORACLES["op11_merkle_manifest"].replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, queries.op11_merkle_manifest(spark, sf).collect()), key=str) == sorted(want, key=str)


def test_only_frames_and_sql(spark):
    plan = merkle.checked(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
