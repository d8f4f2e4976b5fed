"""What a task finds by itself is dealt over all buckets, whatever the number of tasks."""

import numpy as np
import pyarrow as pa

from tessera.llm import chaining


def batch(first: int, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts)], names=["b", "text"])


class Listed:
    def __init__(self, short, long_):
        self.value = np.unique(short), np.unique(long_)


def test_matches_of_all_tasks_meet_in_no_bucket():
    rng = np.random.default_rng(3)
    text = " ".join(map(str, rng.integers(0, 1 << 40, 400)))
    (c,) = chaining.chunks([batch(0, [text])])
    listed = Listed(*(s["h"] & chaining.SEED_BITS for s in chaining.seeds(c)))
    got, buckets, tasks = {}, 16, 64
    for task in range(tasks):
        for out in chaining._hot_places(buckets, listed)([batch(100 * task, [text] * 60)]):
            for bucket, kind, data in zip(*(out.column(k).to_pylist() for k in range(3))):
                if kind == 2:
                    got.setdefault(bucket, []).append(chaining._unpacked(data, chaining.MATCH))
    sizes = {b: sum(map(len, x)) for b, x in got.items()}
    assert len(sizes) == buckets  # all went to bucket 0 before
    assert max(sizes.values()) < 4 * sum(sizes.values()) / buckets
    found = np.concatenate([m for x in got.values() for m in x])
    assert set(zip(found["doc"].tolist(), found["other"].tolist())) == {(100 * t + k, 100 * t) for t in range(tasks) for k in range(1, 60)}


def test_pieces_hold_every_match(monkeypatch):
    monkeypatch.setattr(chaining, "PIECE_ROWS", 7)
    m = np.zeros(100, chaining.MATCH)
    m["doc"], m["other"], m["pos"] = np.arange(100) - 3, 5, np.arange(100) * 9
    rows = chaining._dealt(m, 4)
    assert len(rows) == 15 and {b for b, _, _ in rows} <= set(range(4)) and {k for _, k, _ in rows} == {2}
    assert (np.concatenate([chaining._unpacked(d, chaining.MATCH) for _, _, d in rows]) == m).all()
    assert chaining._dealt(m[:0], 4) == []


def test_among_a_sorted_list():
    h = np.array([5, 1, 9, 0, 7], np.uint64)
    assert chaining._among(h, np.array([1, 7], np.uint64)).tolist() == [False, True, False, False, True]
    assert not chaining._among(h, np.zeros(0, np.uint64)).any() and len(chaining._among(h[:0], h[:1])) == 0
