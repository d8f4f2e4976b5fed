"""Toxicity: features against a loop, held-out accuracy, and that no held-out label has any part in a score."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import toxicity
from tessera.llm.common import chunks

SCHEMA = "doc_id long, text string, lang string, id long, features string, score double"
BAD = ["grobbel", "snarkig", "vexofant", "vexolist", "blurtz"]


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    out = []
    for i in range(n):
        words, toxic = [rng.choice(plain) for _ in range(rng.randint(5, 200))], rng.random() < 0.2
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice([*BAD, "vexo" + rng.choice(plain), "GROBBEL!", "you, snarkig", "gr0bbel"])
        out.append((i, " ".join(words) + ".", int(toxic)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", 0.5) for i, t, _ in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def apart(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_texts_are_told_apart(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == apart(i) and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3) for i, _, _ in rows)
    test = [(got[i].score, y) for i, _, y in rows if apart(i)]
    good, bad = [s for s, y in test if not y], [s for s, y in test if y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.95 and sum(got[i].predicted == y for i, _, y in rows if apart(i)) > 0.93 * len(test)
    # labels of held-out rows, and other columns, don't matter
    lied = labels.selectExpr("doc_id", "IF(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    again = {r.doc_id: r.score for r in toxicity.score(docs.drop("score", "id").withColumnsRenamed({"lang": "kind"}), lied).collect()}
    assert all(math.isclose(again[i], got[i].score, abs_tol=1e-12) for i in got)


def naive(text, weights):
    """The features by a loop over words."""
    import re

    marks = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = [w.strip(marks) or w for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    n = len(words)

    def weigh(w):
        raw = w.translate(lower).encode()
        return max([weights.get(raw, 0)] + [weights.get(raw[:k] + b"*", 0) for k in toxicity.BEGINNINGS if len(raw) > k])

    def letters(w):
        return sum(chr(b).isascii() and chr(b).isalpha() or b >= 128 for b in w.encode())

    odd = [letters(w) > 0 and any(c in "0123456789@$!|+*#" for c in w) for w in words]
    hidden = [weigh(w.translate(str.maketrans(toxicity.LEET))) if o else 0 for w, o in zip(words, odd)]
    weight = [max(weigh(w), h) for w, h in zip(words, hidden)]
    you = [k for k, w in enumerate(words) if w.translate(lower) in toxicity.SECOND.split()]
    near = [bool(x) and any(abs(k - y) <= toxicity.NEAR for y in you) for k, x in enumerate(weight)]
    raw, hits, some = text.encode(), sum(x > 0 for x in weight), max(n, 1)
    size, all_letters = max(len(raw), 1), max(letters(text), 1)
    up = [sum("A" <= c <= "Z" for c in w) for w in words]
    is_mark = [chr(b) in marks and b < 128 for b in raw]
    return [
        math.log1p(n), sum(weight) / some, math.log1p(sum(weight)), math.log1p(hits), max(weight, default=0), hits / some, len(you) / some, sum(near) / some, math.log1p(sum(near)),
        sum(65 <= b <= 90 for b in raw) / all_letters, sum(letters(w) > 1 and u == letters(w) for w, u in zip(words, up)) / some, sum(b in b"!?" for b in raw) / size, sum(is_mark) / size,
        sum(is_mark[k] and raw[k] == raw[k - 1] for k in range(1, len(raw))) / size, sum(odd) / some, sum(hidden) / some, math.log1p(some / (text.count("\n") + 1)), sum(len(w.encode()) for w in words) / some,
    ]


def test_features_against_a_loop():
    weights = {b"idiot": 3.0, b"loser": 2.0, b"vexo*": 1.5, b"i*": 9.0}
    lexicon = toxicity.Lexicon.of(list(weights.items()))
    texts = ["", "  ", "You IDIOT!! you are a (loser), vexolist vexo ÉTÉ.", "... !!! ***", "1d10t and l0$er\nnot idiots", "tú, " + "a " * 5 + "idiot", "idiot", "x" * 9000 + " Loser", "\nid10t?", "du"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["a", "b"])
    got = np.concatenate([toxicity.features(c, lexicon) for c in chunks([batch], 60)])
    assert np.allclose(got, [naive(t, weights) for t in texts])


def test_counts_of_the_lexicon(spark):
    texts = [(1, "Grob grobian, grob"), (0, "grobi fein"), (3, "GROBIAN"), (7, "fein fein grobian"), (7, "")]
    rows, sizes = toxicity.lexicon(spark.createDataFrame(texts, "kind long, text string").repartition(2))
    got = {bytes(r.key): r for r in rows.collect()}
    assert sizes == {(0, 1): 1, (0, 0): 1, (1, 1): 1, (3, 1): 2}
    assert set(got) == {b"grob*", b"grobi*", b"grobia*", b"grobian"}
    assert (got[b"grob*"].t0, got[b"grob*"].c0, got[b"grob*"].t1, got[b"grob*"].t3) == (1, 1, 1, 1)


@pytest.mark.parametrize("share", [0, 1, None])
def test_one_class_or_no_labels(spark, share):
    rows = [(i, t, share) for i, t, _ in corpus(40)]
    docs, labels = frames(spark, rows)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 40 and {r.score for r in got} == {float(share or 0)}


def test_awkward_rows(spark):
    rows = corpus(300)
    docs, labels = frames(spark, [*rows, (5000, None, 0), (5001, "", 0), (5002, "grobbel " * 30_000, 1), (5003, rows[3][1], rows[3][2]), (3, "another grobbel text", 1)])
    docs = docs.union(spark.createDataFrame([(None, "no id", "x", 1, "y", 0.5)], SCHEMA)).cache()
    labels = labels.union(spark.createDataFrame([(9999, 1), (1, None), (None, 1)], labels.schema)).cache()
    got = toxicity.score(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(300), 3, 5000, 5001, 5002, 5003])
    by = {r.doc_id: r.score for r in got}
    assert by[5000] == by[5001] and by[5002] > 0.3
    assert toxicity.score(docs.limit(0), labels).count() == 0 and toxicity.score(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_a_fit_on_a_bounded_share(spark):
    docs, labels = frames(spark, corpus())
    n = toxicity.labelled(docs, labels, most=200).count()
    assert 120 < n < 280 and toxicity.labelled(docs, labels).count() == sum(not apart(i) for i in range(900))
    same = spark.createDataFrame([(1, "copy", "x", 1, "y", 0.0), (1, "other text", "x", 1, "y", 0.0), (3, "copy", "x", 1, "y", 0.0), (4, None, "x", 1, "y", 0.0)], SCHEMA)
    told = spark.createDataFrame([(1, 1), (3, 1), (4, 0), (4, 0)], "doc_id long, toxic int")
    assert sorted(r.text for r in toxicity.labelled(same, told).collect()) == sorted(t for t, i in (("", 4), ("copy", 1), ("other text", 1)) if not apart(i))
