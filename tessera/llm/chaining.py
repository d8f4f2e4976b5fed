"""Fuzzy repeated passages by collinear chaining of shared word k-mers.

Seeds are minimizers of two kinds: short ones (5 words), which survive edits, and long ones (40 words), which most exact
copies share. Both are exchanged by hash alone first. A seed of few places (``ALL``) is matched with every earlier
holder. Most seeds occur once and go no further; the hashes of those with more places are listed, and their places are
exchanged once more with what stands around them:

* A long one carries ten words of each side. A run of 50 words that two documents share always holds one long minimizer
  of both, and the words left and right of it in the run are ten together. So it is matched by each of the eleven ways to
  part those ten words, with the first holder that agrees: whatever exact run of 50 words an earlier document has is
  compared with such a document, however many others hold a part of it.
* A short one carries its neighbours, the six short seeds before it and behind it. Together with each of them it is
  matched with every earlier holder of both if they have few places, else with the first one. A chain has neighbours, so
  a seed that shares none with a holder is in no chain with it.

So a passage that a third of all documents share gives a few matches per place and never one per pair.

The matches of a document with one earlier document are chained: the best predecessor of a match, among those within the
gap bound before it in both texts, is found in Fenwick trees of maxima, with linear gap costs folded into the keys.
Chains are aligned on the words of both texts, which decides their ends and their identity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MULT, TO_LOWER, Chunk, ambiguous_ids, arrow_map, chunks, merged, mix, ship, span_hash, table, words, written
from tessera.llm.pairs import side_by_side
from tessera.llm.suffix_dedup import sliding_least

K = 5
WINDOW = 7
LONG_K = 40
LONG_WINDOW = 11
#: Words of both sides of a long seed that make a run of ``MIN_WORDS`` with it.
SIDE = 10
#: A seed of at most so many places is matched with all its earlier holders.
ALL = 16
#: Short seeds of each side that a frequent one is looked up with.
NEAR = 6
#: Seeds are exchanged by so many bits; words decide in the alignment.
SEED_BITS = np.uint64((1 << 48) - 1)
#: A common long seed stands for so many short ones in a chain.
STANDS_FOR = (0, 17, 35)
MIN_SEEDS = 3
#: Words by which a passage may go on beyond the ends of its chain.
EDGE = 12
MIN_WORDS = LONG_K + SIDE
MIN_IDENTITY = 0.8
GAP_COST = 0.01
MAX_GAP = 40
#: Matches before one that are looked at without a tree.
LOOK = 24
#: Words that are aligned at a time from a difference on.
PIECE = 48
FLUSH_BYTES = 12 << 20
#: Matches that go to a bucket at a time.
PIECE_ROWS = 1 << 13
CODES = np.random.default_rng(23).integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
PARTS = np.random.default_rng(29).integers(1, 1 << 63, LONG_K // K, dtype=np.uint64) | np.uint64(1)
SEED = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<u4")])
LONG = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("before", "u1"), ("behind", "u1"), ("left", "<u2", SIDE), ("right", "<u2", SIDE)])
HOT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("near", "<u2", 2 * NEAR)])
MATCH = np.dtype([("doc", "<i8"), ("other", "<i8"), ("pos", "<u4"), ("at", "<u4"), ("long", "u1")])


# ---------------------------------------------------------------- seeds
def word_hashes(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of the words of a chunk; A-Z count as a-z."""
    data = TO_LOWER[c.data]
    start, end, row = words(data, c.offs)
    return span_hash(data, start, end)[0], start, end, row


def _minimizers(h: np.ndarray, row: np.ndarray, size: int, window: int) -> np.ndarray:
    """Places of the least hash of every ``window`` neighbouring ones of one text, the first of equals."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(18, int(len(h)).bit_length()))
    tagged = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    least = sliding_least(tagged, window)
    inside = row[: len(least)] == row[window + size - 2 :]
    return np.unique((least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))


def seeds(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Short and long minimizers of a chunk; positions count words."""
    w, _, _, row = word_hashes(c)
    n, m = len(w) - K + 1, len(w) - LONG_K + 1
    if n < WINDOW:
        return np.zeros(0, SEED), np.zeros(0, LONG)
    first_word = np.searchsorted(row, np.arange(len(c) + 1))
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for k in range(K):
            g += w[k : k + n] * CODES[k]
        g = mix(g)
        at = _minimizers(g, row, K, WINDOW)
        short = np.zeros(len(at), SEED)
        short["h"], short["doc"], short["pos"] = g[at], c.ids[row[at]], at - first_word[row[at]]
        if m < LONG_WINDOW:
            return short, np.zeros(0, LONG)
        h = np.zeros(m, np.uint64)
        for k, code in enumerate(PARTS):
            h += g[k * K : k * K + m] * code
        h = mix(h)
    at = _minimizers(h, row, LONG_K, LONG_WINDOW)
    long_ = np.zeros(len(at), LONG)
    long_["h"], long_["doc"], long_["pos"] = h[at], c.ids[row[at]], at - first_word[row[at]]
    long_["before"], long_["behind"] = np.minimum(at - first_word[row[at]], SIDE), np.minimum(first_word[row[at] + 1] - at - LONG_K, SIDE)
    near = w.astype(np.uint16)
    for k in range(SIDE):
        long_["left"][:, k] = near[np.maximum(at - 1 - k, 0)]
        long_["right"][:, k] = near[np.minimum(at + LONG_K + k, len(w) - 1)]
    return short, long_


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where the group of each begins, and its size."""
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    at = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    return at[which], np.diff(np.r_[at, len(key)])[which]


def _earlier(first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of the same group (in order of documents) that are of different ones, the later one first."""
    place, with_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, ALL):
        i = np.flatnonzero((first[d:] == first[:-d]) & (doc[d:] != doc[:-d])) + d
        place.append(i)
        with_.append(i - d)
    return np.concatenate(place), np.concatenate(with_)


def _few(s: np.ndarray) -> np.ndarray:
    """Places of seeds; of a seed with more than ``ALL`` as many as show that it has, and other documents if there are."""
    s = s[np.lexsort((s["pos"], s["doc"], s["h"]))]
    first, n = _groups(s["h"])
    rank = np.arange(len(s)) - first
    return s[(rank < ALL) | (rank == n - 1)]


def _all_pairs(s: np.ndarray, long_: int) -> tuple[np.ndarray, np.ndarray]:
    """Matches of the places of each seed with all earlier ones, and the hashes of the seeds that have too many."""
    s = s[np.lexsort((s["pos"], s["doc"], s["h"]))]
    first, n = _groups(s["h"])
    last = first + n - 1
    several = s["doc"][first] != s["doc"][last]
    hot = np.flatnonzero(several & (n > ALL) & (first == np.arange(len(s))))
    few = np.flatnonzero(several & (n <= ALL))
    return _matches(s[few], *_earlier(first[few], s["doc"][few]), long_), s["h"][hot]


def _near_stars(s: np.ndarray, last: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Frequent short seeds, each with every neighbour it has: with few places matched with all earlier ones of both,
    else with the first holder. What isn't the ``last`` look only makes matches of the second kind, and leaves out places
    that are settled by them."""
    s = s[np.lexsort((s["pos"], s["doc"]))]
    with np.errstate(over="ignore"):
        side = np.repeat(np.arange(2, dtype=np.uint64), NEAR) << np.uint64(16)
        key = mix(s["h"][:, None] + (s["near"].astype(np.uint64) | side) * MULT).ravel()
    i = np.repeat(np.arange(len(s)), 2 * NEAR)
    there = s["near"].ravel() > 0
    key, i = key[there], i[there]
    order = np.lexsort((i, key))
    key, i = key[order], i[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1])][: len(key)]
    key, i = key[new], i[new]
    first, n = _groups(key)
    doc = s["doc"][i]
    many, own = n > ALL, doc == doc[first]
    star = np.flatnonzero(many & ~own)
    keep = np.zeros(len(s), bool)
    keep[i[~many | own]] = True
    place, with_ = [i[star]], [i[first[star]]]
    if last:
        few = np.flatnonzero(~many)
        x, y = _earlier(first[few], doc[few])
        place.append(i[few[x]])
        with_.append(i[few[y]])
    pair = np.unique(np.concatenate(place) * max(len(s), 1) + np.concatenate(with_))
    return s[keep], _matches(s, pair // max(len(s), 1), pair % max(len(s), 1), 0)


def _matches(s: np.ndarray, m: np.ndarray, with_: np.ndarray, long_: int) -> np.ndarray:
    out = np.zeros(len(m), MATCH)
    out["doc"], out["pos"], out["other"], out["at"], out["long"] = s["doc"][m], s["pos"][m], s["doc"][with_], s["pos"][with_], long_
    return out


def _long_stars(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of long seeds that are first for some way to part ``SIDE`` words to their sides, and matches of all others'
    places with the first place of each way."""
    s = s[np.lexsort((s["pos"], s["doc"]))]
    keep, place, with_ = np.zeros(len(s), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        left, right = [s["h"]], [mix(s["h"] + MULT)]
        for k in range(SIDE):
            left.append(mix(left[-1] + s["left"][:, k]))
            right.append(mix(right[-1] + s["right"][:, k]))
        for k in range(SIDE + 1):
            ok = np.flatnonzero((s["before"] >= k) & (s["behind"] >= SIDE - k))
            key = left[k][ok] + right[SIDE - k][ok] * MULT
            order = np.argsort(key, kind="stable")
            key, i = key[order], ok[order]
            new = np.r_[True, key[1:] != key[:-1]][: len(i)]
            first = i[np.flatnonzero(new)[np.cumsum(new) - 1]]
            own = s["doc"][i] == s["doc"][first]
            keep[i[own]] = True
            place.append(i[~own])
            with_.append(first[~own])
    # of the ways that lead a place to one document the first and the last: between them they reach farthest out
    at, of = np.concatenate(place), np.concatenate(with_)
    order = np.lexsort((s["doc"][of], at))
    at, of = at[order], of[order]
    new = np.r_[True, (at[1:] != at[:-1]) | (s["doc"][of[1:]] != s["doc"][of[:-1]])][: len(at)]
    ends = np.flatnonzero(new | np.r_[new[1:], True][: len(at)])
    ends = ends[np.r_[True, (at[ends[1:]] != at[ends[:-1]]) | (of[ends[1:]] != of[ends[:-1]])][: len(ends)]]
    return s[keep], _matches(s, at[ends], of[ends], 1)


def _packed(a: np.ndarray) -> bytes:
    """Column by column and, in a column, byte by byte of each value; ids as steps from the one before. The high bytes
    of ids and places are mostly nought then and are squeezed by the shuffle's compression."""
    a = a[np.lexsort((a["pos"], a["doc"]))]
    a["doc"][1:] = np.diff(a["doc"])
    return b"".join(np.ascontiguousarray(a[name]).view(np.uint8).reshape(len(a), a.dtype[name].itemsize).T.tobytes() for name in a.dtype.names)


def _unpacked(data: bytes, dtype: np.dtype) -> np.ndarray:
    out, at = np.zeros(len(data) // dtype.itemsize, dtype), 0
    for name in dtype.names:
        size = dtype[name].itemsize
        column = np.frombuffer(data, np.uint8, len(out) * size, at).reshape(size, len(out))
        out[name] = np.ascontiguousarray(column.T).view(dtype[name].base).reshape(out[name].shape)
        at += column.nbytes
    out["doc"] = np.cumsum(out["doc"])
    return out


EXCHANGED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _by_bucket(s: np.ndarray, kind: int, buckets: int) -> list[tuple[int, int, bytes]]:
    bucket = (s["h"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    s, bucket = s[order], bucket[order]
    at = np.flatnonzero(np.r_[True, np.diff(bucket) > 0]) if len(s) else []
    return [(int(bucket[a]), kind, _packed(s[a:b])) for a, b in zip(at, np.r_[at[1:], len(s)])]


def _dealt(m: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Matches in pieces, each to a bucket of its own: they need no other rows, and no bucket may get those of all tasks."""
    first = m[::PIECE_ROWS]
    with np.errstate(over="ignore"):
        bucket = mix(first["doc"].astype(np.uint64) * MULT + first["pos"]) % np.uint64(buckets)
    return [(b, 2, _packed(m[k * PIECE_ROWS : (k + 1) * PIECE_ROWS])) for k, b in enumerate(bucket.tolist())]


def _exchange(found, flush):
    """Rows (bucket, kind, data): what ``found`` takes from a chunk, by ``flush`` some megabytes at a time."""

    def out(held):
        rows = flush([np.concatenate(x) for x in zip(*held)])
        return table(EXCHANGED, *map(list, zip(*rows))) if rows else table(EXCHANGED, [], [], [])

    def run(batches):
        held, size = [], 0
        for c in chunks(batches):
            s = found(c)
            held.append(s)
            size += sum(x.nbytes for x in s)
            if size > FLUSH_BYTES:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return run


def _places(c: Chunk) -> list[np.ndarray]:
    """Places of the short and the long seeds of a chunk."""
    out = []
    for s in seeds(c):
        x = np.zeros(len(s), SEED)
        x["h"], x["doc"], x["pos"] = s["h"] & SEED_BITS, s["doc"], s["pos"]
        out.append(x)
    return out


def _all_places(buckets: int):
    return _exchange(_places, lambda s: [row for kind, x in enumerate(s) for row in _by_bucket(_few(x), kind, buckets)])


def _among(h: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether hashes are in a sorted list, which is not sorted anew for each chunk."""
    return listed[np.minimum(np.searchsorted(listed, h), len(listed) - 1)] == h if len(listed) else np.zeros(len(h), bool)


def _hot_places(buckets: int, listed):
    """The places of listed seeds (a broadcast pair of sorted arrays) with what stands around them."""

    def found(c: Chunk) -> list[np.ndarray]:
        short, long_ = seeds(c)
        short["h"] &= SEED_BITS
        long_["h"] &= SEED_BITS
        hot, wide = listed.value
        at = np.flatnonzero(_among(short["h"], hot))
        out = np.zeros(len(at), HOT)
        for name in SEED.names:
            out[name] = short[name][at]
        near = np.maximum((short["h"] >> np.uint64(16)).astype(np.uint16), 1)
        for k in range(NEAR):
            for column, step in ((k, -1 - k), (NEAR + k, 1 + k)):
                to = np.clip(at + step, 0, max(len(short) - 1, 0))
                out["near"][:, column] = np.where((to == at + step) & (short["doc"][to] == short["doc"][at]), near[to], 0)
        return [out, long_[_among(long_["h"], wide)]]

    def flush(s):
        rows = []
        for kind, (first, matched) in enumerate((_near_stars(s[0], last=False), _long_stars(s[1]))):
            rows += _by_bucket(first, kind, buckets)
            rows += _dealt(matched, buckets)
        return rows

    return _exchange(found, flush)


def _of(pdf: pd.DataFrame, kind: int, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(_unpacked(x, dtype) for x in pdf["data"][pdf["kind"] == kind])])


#: Rows of matches; ``long`` is 2 or 3 for the hash (in ``doc``) of a short or long seed with too many places.
MATCHES = "doc long, other long, pos int, at int, long tinyint"


def _frame(found: list[np.ndarray], hot: tuple[np.ndarray, ...] = ()) -> pd.DataFrame:
    """Matches of several kinds as one table; each column is put together once."""
    more = np.zeros(sum(map(len, hot)), MATCH)
    if len(more):
        more["doc"], more["long"] = np.concatenate(hot).view(np.int64), np.repeat(np.arange(2, 4), [*map(len, hot)])
    found = [*found, more]
    types = {"doc": np.int64, "other": np.int64, "pos": np.int32, "at": np.int32, "long": np.int8}
    return pd.DataFrame({c: np.concatenate([m[c] for m in found], dtype=t, casting="unsafe") for c, t in types.items()}, copy=False)


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    (m, hot), (w, wide) = (_all_pairs(_of(pdf, kind, SEED), kind) for kind in (0, 1))
    return _frame([m, w], (hot, wide))


def _match_hot(pdf: pd.DataFrame) -> pd.DataFrame:
    return _frame([_of(pdf, 2, MATCH), _near_stars(_of(pdf, 0, HOT))[1], _long_stars(_of(pdf, 1, LONG))[1]])


# ---------------------------------------------------------------- chains
class Maxima:
    """A Fenwick tree: ``best(i)`` is the largest value put at a place up to i, with who put it (the first of equals)."""

    __slots__ = ("values", "who", "size")

    def __init__(self, size: int):
        self.values, self.who, self.size = [float("-inf")] * (size + 1), [-1] * (size + 1), size

    def put(self, i: int, value: float, who: int) -> None:
        values, size = self.values, self.size
        i += 1
        while i <= size:
            if value > values[i] or (value == values[i] and who < self.who[i]):
                values[i], self.who[i] = value, who
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        values, out, who = self.values, float("-inf"), -1
        i += 1
        while i:
            if values[i] > out or (values[i] == out and self.who[i] < who):
                out, who = values[i], self.who[i]
            i -= i & -i
        return out, who


def better(x: tuple[float, int], y: tuple[float, int]) -> tuple[float, int]:
    """The larger value, of equals the one that was there first."""
    return y if y[0] > x[0] or (y[0] == x[0] and y[1] < x[1]) else x


class Reach:
    """Matches by their place in the other text, in stretches as long as the reach: each has a tree from its start and one
    from its end, so the places from ``a - reach`` to ``a - 1`` are an end of one stretch and a start of the next."""

    def __init__(self, reach: int):
        self.reach, self.trees = reach, {}

    def put(self, a: int, value: float, who: int) -> None:
        k, i = divmod(a, self.reach)
        if k not in self.trees:
            self.trees[k] = Maxima(self.reach), Maxima(self.reach)
        up, down = self.trees[k]
        up.put(i, value, who)
        down.put(self.reach - 1 - i, value, who)

    def best(self, a: int) -> tuple[float, int]:
        k, i = divmod(a, self.reach)
        out = (float("-inf"), -1)
        if i and k in self.trees:
            out = self.trees[k][0].best(i - 1)
        if k - 1 in self.trees:
            out = better(out, self.trees[k - 1][1].best(self.reach - 1 - i))
        return out


def _ahead(p: list[int], a: list[int], key: list[float], last: int, low: int, start: int, high: int, reach: int) -> list[tuple[float, int]]:
    """For matches ``start`` to ``high``: the best predecessor in the stretch before, which is ``last`` to ``low``."""
    out: list[tuple[float, int]] = [(float("-inf"), -1)] * (high - start)
    trees, i = Reach(reach), low - 1
    for j in range(high - 1, start - 1, -1) if last < low else ():
        while i >= last and p[i] >= p[j] - reach:
            trees.put(a[i], key[i], i)
            i -= 1
        out[j - start] = trees.best(a[j])
    return out


def chains(pos: np.ndarray, at: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[tuple[int, int, int, int, int]]:
    """Collinear chains of matches: (first pos, last pos, first at, last at, seeds), best first.

    A chain's score is one per match less ``gap_cost`` per word between neighbours in either text; neighbours are at
    most ``max_gap + K`` words apart in both. The best predecessor within that bound is found in Fenwick trees, so a far
    match never hides a near one: positions are cut into stretches as long as the bound, and the trees of the stretch
    before are filled from its end, as far as each match reaches. A match costs the logarithm of the bound; no tree is
    asked where the match before it has the best key of all, or where at most ``LOOK`` matches before it tell.
    """
    order = np.lexsort((at, pos))
    pos, at = pos[order], at[order]
    reach = max_gap + K
    key = (gap_cost * (pos + at)).tolist()  # the score is added below
    p, a = pos.tolist(), at.tolist()
    n = len(p)
    score, back = [0.0] * n, [-1] * n
    cuts = [0, *(np.flatnonzero(np.diff(pos // reach)) + 1).tolist(), n] if n else [0]
    top = kept = float("-inf")
    tops: list[float] = []  # the best key up to each match
    for c, (low, high) in enumerate(zip(cuts, cuts[1:])):
        last = cuts[c - 1] if c and p[low - 1] // reach == p[low] // reach - 1 else low
        own, put, far, since = None, low, [], low
        for j in range(low, high):
            pj, aj, kj = p[j], a[j], key[j]
            if j and kept >= top and kept > kj and pj - reach <= p[j - 1] < pj and aj - reach <= a[j - 1] < aj:
                best, who = kept, j - 1  # the best of all so far, and within reach
            else:
                found = own is None
                if found:
                    best, who, i, end = float("-inf"), -1, j - 1, max(j - 1 - LOOK, -1)
                    while i > end and p[i] >= pj - reach and tops[i] >= best:
                        if key[i] >= best and aj - reach <= a[i] < aj and p[i] < pj:
                            best, who = key[i], i
                        i -= 1
                    found = i < 0 or p[i] < pj - reach or tops[i] < best
                if not found:
                    if own is None:
                        own, far, since = Reach(reach), _ahead(p, a, key, last, low, j, high, reach), j
                    while p[put] < pj:  # equal positions can't follow each other
                        own.put(a[put], key[put], put)
                        put += 1
                    best, who = better(far[j - since], own.best(aj))
                if best <= kj:
                    best, who = kj, -1
            score[j], back[j] = 1.0 + best - kj, who
            key[j] = kept = 1.0 + best  # the score and the costs up to here
            if kept > top:
                top = kept
            tops.append(top)
    used, out = [False] * n, []
    for e in np.argsort(-np.array(score), kind="stable").tolist():
        if used[e]:
            continue
        count, s = 0, e
        k = e
        while k >= 0 and not used[k]:
            used[k] = True
            count, s, k = count + 1, k, back[k]
        out.append((p[s], p[e], a[s], a[e], count))
    return out


CHAINS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("chains", pa.list_(pa.int32()))])


def _chain(min_words: int):
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], []]
            lists = b.column(2)
            pos, at, long_ = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            places = (pos.astype(np.uint64) << np.uint64(33)) | (at.astype(np.uint64) << np.uint64(1)) | (long_ == 1)
            ends = lists.offsets.to_numpy().tolist()
            for i, (doc, other) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                # a place is found by each of its neighbours, in several tasks
                one = np.unique(places[ends[i] : ends[i + 1]])
                p, a, wide = (one >> np.uint64(33)).astype(np.int64), (one >> np.uint64(1) & np.uint64(0xFFFFFFFF)).astype(np.int64), one & np.uint64(1) == 1
                found = chains(np.concatenate([p[~wide], *(p[wide] + k for k in STANDS_FOR)]), np.concatenate([a[~wide], *(a[wide] + k for k in STANDS_FOR)]))
                # both ends may lie some windows of seeds farther out, as edits hide seeds
                keep = [v for c in found if c[4] >= MIN_SEEDS and c[1] - c[0] + K + 2 * EDGE >= min_words for v in c[:4]]
                if keep:
                    for col, v in zip(out, (other, doc, keep)):
                        col.append(v)
            yield table(CHAINS, *out)

    return run


# ---------------------------------------------------------------- alignment
def _reach(x: np.ndarray, y: np.ndarray, miss: float = 2.0, drop: float = 8.0) -> int:
    """How far two word sequences go on together (substitutions allowed): the best-scoring common length."""
    n = min(len(x), len(y))
    total, far, step = 0.0, 0, 256
    best = 0.0
    for k in range(0, n, step):
        s = total + np.cumsum(np.where(x[k : min(k + step, n)] == y[k : min(k + step, n)], 1.0, -miss))
        peak = np.maximum.accumulate(np.maximum(s, best))
        end = np.flatnonzero(peak - s > drop)
        s = s[: end[0]] if len(end) else s
        if len(s) and s.max() > best:
            best, far = float(s.max()), k + int(s.argmax()) + 1
        if len(end) or not len(s):
            break
        total = float(s[-1])
    return far


def _best_end(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Longest common subsequence of a word sequence with a beginning of another, and the shortest such beginning."""
    # a row of the table is one number: bit j is 0 where the subsequence with y[: j + 1] is one longer than with y[:j]
    places: dict[int, int] = {}
    bit = 1
    for w in y.tolist():
        places[w] = places.get(w, 0) | bit
        bit <<= 1
    full = row = bit - 1
    for w in x.tolist():
        if w in places:
            met = row & places[w]
            row = (row + met | row - met) & full
    longer = full & ~row
    return longer.bit_count(), longer.bit_length()


def align(x: np.ndarray, y: np.ndarray, chain: tuple[int, int, int, int]) -> tuple[int, int, int, int, float]:
    """Ends (half open, in both texts) and identity of a chain: extended at both ends, aligned between in pieces."""
    s, e, ps, pe = chain
    e, pe = e + K, pe + K
    left = _reach(x[:s][::-1], y[:ps][::-1])
    right = _reach(x[e:], y[pe:])
    s, ps, e, pe = s - left, ps - left, e + right, pe + right
    same, i, j = 0, s, ps
    while i < e and j < pe:
        n = min(e - i, pe - j, 4096)
        apart = x[i : i + n] != y[j : j + n]
        d = int(apart.argmax()) if apart.any() else n
        same, i, j = same + d, i + d, j + d
        if d == n:
            continue
        # from a difference on, a piece against as much of the other text as a gap can take; what it needs is used up
        m = min(PIECE, e - i)
        found, used = _best_end(x[i : i + m], y[j : min(j + m + MAX_GAP, pe)])
        same, i, j = same + found, i + m, j + used
    return s, e, ps, pe, same / max(e - s, pe - ps, 1)


PASSAGES = pa.schema([("doc_id", pa.int64()), ("other_id", pa.int64()), *((k, pa.int64()) for k in ("start", "end", "other_start", "other_end", "n_words")), ("identity", pa.float64())])


def _align(min_words: int, min_identity: float):
    """Rows (a, b, role, text, chains) of ``side_by_side``: passages, with byte positions."""

    def run(batches):
        leader, own = None, None
        for batch in batches:
            at, out = 0, [[] for _ in PASSAGES]
            a, role, given = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4)
            for c in chunks([pa.RecordBatch.from_arrays([batch.column(1), batch.column(3)], names=["b", "t"])]):
                w, start, end, row = word_hashes(c)
                first = np.searchsorted(row, np.arange(len(c) + 1))
                for i in range(len(c)):
                    k, f, t, o = at + i, first[i], first[i + 1], c.offs[i]
                    mine = (w[f:t], start[f:t] - o, end[f:t] - o)
                    if role[k] == 0:
                        leader, own = a[k], mine
                        continue
                    if a[k] != leader:
                        continue
                    done: list[tuple[int, int]] = []
                    flat = given[k].as_py()
                    for q in range(0, len(flat), 4):
                        if any(x <= flat[q] and flat[q + 1] + K <= y for x, y in done):
                            continue  # its seeds lie in a passage that stands
                        s, e, ps, pe, same = align(mine[0], own[0], tuple(flat[q : q + 4]))
                        if e - s < min_words or same < min_identity or any(x <= s and e <= y for x, y in done):
                            continue
                        done.append((s, e))
                        for col, v in zip(out, (int(c.ids[i]), leader, int(mine[1][s]), int(mine[2][e - 1]), int(own[1][ps]), int(own[2][pe - 1]), e - s, same)):
                            col.append(v)
                at += len(c)
            yield table(PASSAGES, *out)

    return run


# ---------------------------------------------------------------- operators
def passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least ``min_words`` words that an earlier document (a smaller id) has too, up to small edits.

    One row per passage: ``doc_id, other_id, start, end, other_start, other_end`` (bytes), ``n_words, identity``.
    ``identity`` is the longest common subsequence over the longer side, in words, A-Z as a-z. Every exact run of 50
    words that an earlier document has is covered, whoever else holds parts of it; edited passages are found through
    short seeds. Holders are those of a task first, then of all, so where several earlier documents have a passage, which
    one ``other_id`` names can depend on the partitioning.
    Null, empty and short texts have no passages; repeats inside one document and rows that repeat an id don't count; rows without an id are left out;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("b"), F.col(text_col).cast("string").alias("text")).where("b is not null")
    return _aligned(_chained(rows, min_words), rows, min_words, min_identity)


def _chained(rows: DataFrame, min_words: int) -> DataFrame:
    """Rows (a, b, chains): what document b shares with an earlier one, out of rows (b, text)."""
    ship(rows.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (8 << 20)))
    packed = arrow_map(rows, _all_places(buckets), "bucket int, kind int, data binary")
    found = written(packed.groupBy("bucket").applyInPandas(_match, MATCHES), "matches")
    matches = found.where("long < 2")
    listed = found.where("long > 1").select("doc", "long").toArrow()
    if listed.num_rows:
        h, kind = listed["doc"].to_numpy().view(np.uint64), listed["long"].to_numpy()
        hot = rows.sparkSession.sparkContext.broadcast((np.sort(h[kind == 2]), np.sort(h[kind == 3])))
        packed = arrow_map(rows, _hot_places(buckets, hot), "bucket int, kind int, data binary")
        matches = matches.unionByName(packed.groupBy("bucket").applyInPandas(_match_hot, MATCHES))
    seeds_ = F.sum(F.when(F.col("long") == 1, len(STANDS_FOR)).otherwise(1))
    grouped = matches.groupBy("doc", "other").agg(F.collect_list(F.struct("pos", "at", "long")).alias("m"), seeds_.alias("seeds")).where(F.col("seeds") >= MIN_SEEDS).drop("seeds")
    return arrow_map(grouped, _chain(min_words), "a long, b long, chains array<int>")


def _aligned(found: DataFrame, rows: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    schema = "doc_id long, other_id long, start long, end long, other_start long, other_end long, n_words long, identity double"
    return arrow_map(side_by_side(found, rows.withColumnRenamed("b", "doc_id")), _align(min_words, min_identity), schema)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the union of their spans (bytes); null where there are none."""
    left = []
    for text, found in zip(texts.cast(pa.large_binary()).to_pylist(), spans.to_pylist()):
        if found is None:
            left.append(None)
            continue
        s, e = merged(np.array([x["start"] for x in found]), np.array([x["end"] for x in found]))
        at = [0, *np.stack([s, e], 1).ravel().tolist(), len(text)]
        left.append(b"".join(text[at[k] : at[k + 1]] for k in range(0, len(at), 2)).decode("utf-8", "replace"))
    return pa.array(left, pa.string())


def drop_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The input with every passage cut that an earlier document has; the first occurrence stays.

    All columns stay. A document of which no word is left goes; ends of passages are ends of words, so characters
    stay whole. ``length_col`` names a column that holds the text's length in characters, to be kept right. Rows
    without an id, and rows whose id names different texts, are neither cut nor compared; rows that repeat an id and
    its text are cut alike. Null, empty and blank texts stay as they are; an empty table stays empty.
    """
    rest = F.struct(*("`" + c.replace("`", "``") + "`" for c in docs.columns if c != text_col))
    packed = docs.select(F.col(id_col).cast("long").alias("b"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    named = packed.where("b is not null")
    # written, as a table of known (mostly no) size lets the texts stay where they are in the next join
    doubtful = written(ambiguous_ids(docs, id_col, text_col), "doubtful").withColumnRenamed("id", "b")
    found = _chained(named.select("b", "text").join(doubtful, "b", "left_anti"), min_words)
    # no doubtful id is in a chain. Alignment and cutting read the same columns of the same rows by id, so that the rows
    # are exchanged once for both
    spans = _aligned(found, named, min_words, min_identity).groupBy(F.col("doc_id").alias("b")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = named.hint("merge").join(spans, "b", "left")
    # texts without spans don't go to Python, and the others go once (a filter isn't pushed through what is not deterministic)
    cut = F.arrow_udf(_cut, "string").asNondeterministic()
    left = joined.select("text", "rest", cut(F.when(F.col("spans").isNotNull(), F.col("text")), "spans").alias("left"))
    kept = left.where(F.col("left").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    kept = kept.unionByName(packed.where("b is null").select("text", "rest"), allowMissingColumns=True)
    changed = {text_col: F.coalesce("left", "text")}
    if length_col:
        changed[length_col] = F.coalesce(F.char_length("left").cast(docs.schema[length_col].dataType), F.col("rest")[length_col])
    return kept.select(*(changed[c] if c in changed else F.col("rest")[c] for c in docs.columns)).toDF(*docs.columns)
