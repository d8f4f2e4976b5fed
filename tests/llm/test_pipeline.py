"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import word_bpe
from tests.llm.test_ops import LOWER, WORD, base_counts, brute_near, brute_passages, words_of


def corpus():
    rng = random.Random(77)
    fresh = lambda n: words_of(rng, n, 10**6)
    one, near_ = fresh(120), fresh(150)
    changed = near_.split()
    changed[70] = "changed"
    passage = fresh(70)
    return [
        (5, one), (3, one.upper()), (9, one), (7, near_), (8, " ".join(changed)), (11, fresh(30) + " " + passage + " " + fresh(30)), (12, f"{fresh(20)} {passage} {fresh(20)}"), (13, passage),
        (20, "too few words"), (21, None), (22, ""), (23, " \n"), (24, "a b c d e " * 30), (30, fresh(5000)), (31, "Été " + fresh(40)), (31, "Été " + fresh(40)), (None, fresh(40)), (None, "short"), (40, "x" * 5000 + " " + fresh(30)),
    ]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", f"s{k}", len(t or ""), f"clash{k}") for k, (i, t) in enumerate(corpus())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, list(corpus())
    steps = dict(corpus_pipeline.STAGES)

    def rows(df):
        assert df.columns == columns
        got = df.collect()
        assert all(r.n_chars == len(r.text or "") for r in got)
        return collections.Counter((r.doc_id, r.text) for r in got)

    # quality: without labels only the base rules reject
    docs = corpus_pipeline.written(steps["quality_rules"](spark, docs, folder), "t1")
    kept = [(i, t) for i, t in kept if not base_counts(t or "")[5]]
    assert rows(docs) == collections.Counter(kept)
    # exact: the smallest id of each text, rows with an id before those without
    docs = corpus_pipeline.written(steps["exact_dedup"](spark, docs, folder), "t2")
    best = {}
    for i, t in sorted(kept, key=lambda x: (x[0] is None, x[0] or 0)):
        best.setdefault(t.translate(LOWER), (i, t))
    kept = list(best.values())
    assert rows(docs) == collections.Counter(kept)
    # near: ids that name one text
    docs = corpus_pipeline.written(steps["near_dedup"](spark, docs, folder), "t3")
    names = collections.Counter(i for i, _ in kept)
    clear = {i: t for i, t in kept if i is not None and names[i] == 1}
    gone = {i for i, v in brute_near(clear, 5).items() if not v[2]}
    assert gone == {8}
    kept = [(i, t) for i, t in kept if i not in gone]
    assert rows(docs) == collections.Counter(kept)
    # passages: what an earlier document has of 50 words or more is cut, little else
    docs = corpus_pipeline.written(steps["substring_dedup"](spark, docs, folder), "t4")
    clear = [(i, t) for i, t in kept if i is not None and names[i] == 1]
    covered = brute_passages(clear)
    got = rows(docs)
    left = {i: WORD.findall(t) for (i, t) in got if i in covered}
    for i, t in clear:
        w = WORD.findall(t)
        want = [x for k, x in enumerate(w) if k not in covered[i]]
        if not want:
            assert i not in left
        else:
            assert len(want) - 12 <= len(left[i]) <= len(want)
            assert covered[i] or left[i] == w
    assert 13 not in left and len(left[12]) >= 38 and len(left[11]) == 130
    assert {k: n for k, n in got.items() if k[0] not in covered} == {k: n for k, n in collections.Counter(kept).items() if k[0] not in covered}
    # packing
    packed = steps["best_fit_packing"](spark, docs, folder).collect()
    encoder, want = word_bpe.encoder(word_bpe.default_path()).lib, collections.Counter()
    for (i, t), n in got.items():
        if i is not None:
            ids = np.array([*encoder.encode(t, add_special_tokens=False).ids, 0], "<u4")
            for p, a in enumerate(range(0, len(ids), 2048)):
                want[i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"r{name}")
    a, b = (collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in d.collect()) for d in (docs, corpus_pipeline.run(spark, folder)))
    assert a == b and a


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
