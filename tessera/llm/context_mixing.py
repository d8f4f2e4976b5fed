"""Language-model scores by online logistic context mixing over the bits of a token code.

The stream of a document is its words (A-Z lowered) and one end token. A token is a path of binary decisions: has it been
seen behind the two words before it; if not, behind the one before it; if not, at all; if not, it is spelled, bit by
bit along a Huffman tree of bytes. What a positive decision leaves open is coded by the counts of its level: an n-gram's
count over its context's.

Counts of one-, two- and three-word sequences over all training documents are kept under hashes of the words, spread over
buckets whose number grows with the input; each part of the documents asks for its own sequences, once each. They are
taken as they stand when the token comes: without the document's own occurrences (if it trains), with its earlier ones.

Every decision is predicted in ``MODELS`` hashed contexts (how often the context was seen, what the last tokens were, how
far the document has come; when spelling, up to five bytes back, across the word's start). Bit counts of these contexts
come from the training documents, less the occurrence at hand. A logistic mixer combines them with weights that are
gated by the kind of decision, and an adaptive bias for each range of the mixed prediction refines the result. Weights
and biases start alike in every document and learn inside it, ``BLOCK`` decisions at a time, so a score doesn't depend
on order or partitioning.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MULT, TO_LOWER, Chunk, arrow_map, chunks, mix, ship, span_hash, table, words, written

HOLD_OUT = 10
PART_BYTES = 4 << 20
DEAL_BYTES = 8 << 20
MODELS = 6
SLOT_BITS = 18
RANGES = 16
SETS = 8  # weight sets: two each for the three questions and for spelling
BLOCK = 32
RATE, BIAS_RATE, BIASES = 8e-3, 4e-2, 24
WEIGHT = 0.25  # that every document starts with
LANE_TOKENS = 1 << 16
#: Tokens that are no words. Hashes of words are above them.
END, START, BEFORE = np.uint64(1), np.uint64(2), np.uint64(3)
UNI, BI, TRI = 0, 1, 2
#: Two- and three-word sequences are told apart by the bucket and so many bits of their hash.
NARROW = np.uint64(34)
#: Bytes before a spelled word that are kept as its context.
BACK = 5


def is_held_out(ids: np.ndarray) -> np.ndarray:
    return np.fromiter((zlib.crc32(str(i).encode()) % HOLD_OUT == 0 for i in ids.tolist()), bool, len(ids))


# ---------------------------------------------------------------- parts
def _planes(a: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, so that the exchange packs the leading zeros."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _deal(parts: int):
    """Rows (part, payload): documents packed by the part that their id's hash names."""
    import zstandard

    schema = pa.schema([("part", pa.int32()), ("payload", pa.binary())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        held: list[Chunk] = []

        def flush():
            ids = np.concatenate([c.ids for c in held])
            size = np.concatenate([np.diff(c.offs) for c in held])
            data = np.concatenate([c.data for c in held])
            begin = np.cumsum(size) - size
            part = (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
            out: list[list] = [[], []]
            for a, b in zip(cut, np.r_[cut[1:], len(order)]):
                i = order[a:b]
                body = b"".join(data[s : s + n].tobytes() for s, n in zip(begin[i].tolist(), size[i].tolist()))
                out[0].append(int(part[i[0]]))
                out[1].append(pack.compress(np.int64(len(i)).tobytes() + ids[i].tobytes() + size[i].tobytes() + body))
            held.clear()
            return table(schema, *out)

        n = 0
        for c in chunks(batches, 1 << 20):
            held.append(c)
            n += len(c.data)
            if n > DEAL_BYTES:
                yield flush()
                n = 0
        if held:
            yield flush()

    return run


def _documents(payloads: list[bytes]) -> Chunk:
    """The documents of a part in order of their ids."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    ids, sizes, body = [], [], []
    for raw in payloads:
        raw = unpack.decompress(raw)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids.append(np.frombuffer(raw, np.int64, n, 8))
        sizes.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
        body.append(np.frombuffer(raw, np.uint8, offset=8 + 16 * n))
    ids, size, data = np.concatenate(ids), np.concatenate(sizes), np.concatenate(body)
    order = np.lexsort((size, ids))
    begin = (np.cumsum(size) - size)[order]
    size = size[order]
    offs = np.r_[0, np.cumsum(size)]
    at = np.arange(int(offs[-1])) + np.repeat(begin - offs[:-1], size)
    return Chunk(ids[order], data[at], offs)


class Tokens:
    """Tokens of a part: keys of the sequences that end in each, and where its word stands (the end token: nowhere)."""

    def __init__(self, c: Chunk, buckets: int):
        n = len(c)
        self.data = TO_LOWER[c.data]
        start, end, row = words(self.data, c.offs)
        per = np.bincount(row, minlength=n)
        self.first = np.r_[0, np.cumsum(per + 1)]  # of each document, and the total
        total = int(self.first[-1])
        self.row = np.repeat(np.arange(n), per + 1)
        self.train = ~is_held_out(c.ids)
        word = np.ones(total, bool)
        word[self.first[1:] - 1] = False
        self.start, self.end = np.zeros(total, np.int64), np.zeros(total, np.int64)
        self.start[word], self.end[word] = start, end
        w = np.full(total, END)
        w[word] = np.maximum(span_hash(self.data, start, end)[0], np.uint64(16))
        self.n_bytes = np.bincount(row, weights=end - start + 1, minlength=n).astype(np.int64) + 1
        begins = self.first[:-1]
        one = np.r_[START, w[:-1]][:total]
        one[begins] = START
        two = np.r_[BEFORE, one[:-1]][:total]
        two[begins] = BEFORE
        with np.errstate(over="ignore"):
            bi = mix(w + mix(one) * MULT)
            tri = mix(bi + mix(two) * MULT)
        self.keys = [w, self._narrow(bi, buckets), self._narrow(tri, buckets)]

    @staticmethod
    def _narrow(h: np.ndarray, buckets: int) -> np.ndarray:
        return bucket_of(h, buckets) << NARROW | h & ((np.uint64(1) << NARROW) - np.uint64(1))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable argsort: one plain sort of the keys' upper bits with the places below them, checked afterwards."""
    n = len(keys)
    low = np.uint64(max(1, (n - 1).bit_length()))
    room = np.uint64(64 - int(keys.max(initial=0)).bit_length())
    both = keys << room >> low << low | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    k = keys[order]
    return order if (k[1:] >= k[:-1]).all() else np.argsort(keys, kind="stable")


def _fragments(kind: int, keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    bucket = bucket_of(keys, buckets) if kind == UNI else keys >> NARROW
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(keys)]
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut, np.r_[cut[1:], len(keys)])]


# ---------------------------------------------------------------- counts
ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _ask(buckets: int):
    """The sequences of one part, once each, with their number in its training documents, by bucket."""

    def run(group: pa.Table) -> pa.Table:
        t = Tokens(_documents(group.column("payload").to_pylist()), buckets)
        part, rows = group.column("part")[0].as_py(), []
        train = t.train[t.row]
        for kind, keys in enumerate(t.keys):
            order = stable_order(keys)
            keys, mine = keys[order], np.r_[0, np.cumsum(train[order])]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            u, n = keys[new], np.diff(mine[np.r_[new, len(keys)]])
            for bucket, a, b in _fragments(kind, u, buckets):
                rows.append((kind, bucket, part, _planes(np.diff(u[a:b], prepend=np.uint64(0))), _planes(n[a:b])))
        return pa.table(list(map(list, zip(*rows))) or [[]] * 5, schema=ASKED)

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of one bucket, answered to every part in the order in which it asked; sums to part -1."""
    keys = [np.cumsum(_unplanes(x), dtype=np.uint64) for x in pdf["keys"]]
    size = [len(k) for k in keys]
    all_ = np.concatenate(keys)
    order = stable_order(all_)
    new = np.r_[True, np.diff(all_[order]) > 0]
    total = np.add.reduceat(np.concatenate([_unplanes(x) for x in pdf["counts"]]).astype(np.int64)[order], np.flatnonzero(new))
    answer = np.empty(len(all_), np.int64)
    answer[order] = total[np.cumsum(new) - 1]
    answer = np.split(answer, np.cumsum(size)[:-1])
    kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
    out = [(int(p), kind, bucket, _planes(a)) for p, a in zip(pdf["part"], answer)]
    if kind == UNI:
        out.append((-1, kind, bucket, np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()))
    part, kinds, buckets, data = map(list, zip(*out))
    return pd.DataFrame({"part": np.array(part, np.int32), "kind": np.array(kinds, np.int32), "bucket": np.array(buckets, np.int32), "data": data})


# ---------------------------------------------------------------- codes
CODED = pa.schema([
    ("part", pa.int32()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())),
    ("n_bytes", pa.list_(pa.int64())), ("base_sum", pa.list_(pa.float64())), ("bits", pa.list_(pa.float64())), ("codes", pa.binary()), ("novel", pa.binary()),
    ("novel_sizes", pa.list_(pa.int32())), ("histogram", pa.list_(pa.int64())),
])
CODED_SQL = (
    "part int, tokens long, distinct long, ids array<long>, n_tokens array<long>, n_known array<long>, n_bytes array<long>, base_sum array<double>, bits array<double>, "
    "codes binary, novel binary, novel_sizes array<int>, histogram array<long>"
)


def _standing(keys: np.ndarray, t: Tokens, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, its key's total, and the count as it stands: without the own document's (if it trains) later ones."""
    order = stable_order(keys)
    k, r = keys[order], t.row[order]
    new = np.r_[True, k[1:] != k[:-1]]
    run = np.flatnonzero(new | np.r_[True, r[1:] != r[:-1]])
    size = np.diff(np.r_[run, len(k)])
    earlier = np.arange(len(k)) - np.repeat(run, size)
    total = totals[np.cumsum(new) - 1]
    now = total + earlier - np.repeat(size * t.train[r[run]], size)
    out = np.empty((2, len(k)), np.int64)
    out[0, order], out[1, order] = total, now
    return out[0], out[1]


def _level(n: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(n + 1.0)), most).astype(np.uint16)


def _coded(buckets: int):
    """One row per part: what each token's decisions are (16 bits), what its counts cost, and the words to spell."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:  # part -1: sums over the training tokens
            sums = np.sum([np.frombuffer(x, np.int64) for x in answers.column("data").to_pylist()], 0) if answers.num_rows else (0, 0)
            return pa.table([[-1], [int(sums[0])], [int(sums[1])], *([[[]]] * 6), [b""], [b""], [[]], [[]]], schema=CODED)
        c = _documents(docs.column("payload").to_pylist())
        t = Tokens(c, buckets)
        got = sorted(zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("data").to_pylist()))
        totals = [np.concatenate([_unplanes(d).astype(np.int64) for k, _, d in got if k == kind]) for kind in (UNI, BI, TRI)]
        (count, one), (_, two), (_, three) = (_standing(k, t, n) for k, n in zip(t.keys, totals))
        begins, ends, n = t.first[:-1], t.first[1:] - 1, len(c)
        by_one, by_two = np.r_[0, one[:-1]], np.r_[0, two[:-1]]
        by_one[begins], by_two[begins] = one[ends], 0  # a document begins as often as one ends
        level = np.where((by_two > 0) & (three > 0), 0, np.where((by_one > 0) & (two > 0), 1, np.where(one > 0, 2, 3)))
        share = np.select([level == 0, level == 1, level == 2], [three / np.maximum(by_two, 1), two / np.maximum(by_one, 1), one], 1.0)
        # the share of a known token is of all tokens, whose number is not known yet
        bits = np.bincount(t.row, weights=-np.log2(np.where(level == 2, share, np.minimum(share, 1))), minlength=n)
        code = level.astype(np.uint16) | _level(np.maximum(by_two, 0), 15) << np.uint16(2) | _level(np.maximum(by_one, 0), 31) << np.uint16(6)
        # words to spell, each behind the bytes before it; the end is a line feed
        at = np.flatnonzero(level == 3)
        raw = np.concatenate([np.full(BACK, 32, np.uint8), t.data, np.full(2, 32, np.uint8)])  # shifted by BACK
        s, size = t.start[at], (t.end - t.start)[at]
        last = size == 0
        width = np.where(last, 1, size) + 1 + BACK
        before = np.cumsum(width) - width
        k = np.arange(int(width.sum())) - np.repeat(before, width)
        own = np.repeat(s, width) + k
        novel = raw[np.minimum(own, len(raw) - 1)]
        novel[np.repeat(c.offs[:-1][t.row[at]], width) > own - BACK] = 32  # nothing from the document before
        novel[before + BACK - 1] = 32
        novel[before + width - 1] = 32
        tail = before[last]
        novel[(tail[:, None] + np.arange(BACK + 2)).ravel()] = np.tile(np.r_[np.full(BACK, 32), 10, 32].astype(np.uint8), len(tail))
        spelled = np.flatnonzero(t.train[t.row[at]])
        histogram = np.bincount(novel[(k >= BACK) & np.repeat(np.isin(np.arange(len(at)), spelled), width)], minlength=256)
        per = np.diff(t.first)
        known = np.bincount(t.row[count > 0], minlength=n)
        base = np.bincount(t.row, weights=np.log10(count + 0.1), minlength=n)
        part = docs.column("part")[0].as_py()
        return pa.table([[part], [0], [0], [c.ids], [per], [known], [t.n_bytes], [base], [bits], [code.tobytes()], [novel.tobytes()], [width.astype(np.int32)], [histogram]], schema=CODED)

    return run


class Code:
    """Huffman code of the 256 bytes: nodes and bits along each byte's path."""

    def __init__(self, histogram: np.ndarray):
        heap = [(int(c) + 1, i, i) for i, c in enumerate(histogram)]
        heapq.heapify(heap)
        tree, k = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            tree[k] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], k, k))
            k += 1
        paths: list = [None] * 256
        stack = [(heap[0][2], [])]
        while stack:
            node, path = stack.pop()
            if node < 256:
                paths[node] = path
            else:
                for bit in (0, 1):
                    stack.append((tree[node][bit], [*path, (node - 256, bit)]))
        self.length = np.array([len(p) for p in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        node = np.array([n for p in paths for n, _ in p], np.uint64)
        #: A fixed random number for each node.
        self.node = (mix(node + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)

    def spread(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of decisions per byte, node and bit of every decision."""
        n = self.length[raw]
        at = np.arange(int(n.sum())) + np.repeat(self.start[raw] - (np.cumsum(n) - n), n)
        return n, self.node[at], self.bit[at]


def _scrambled(x: np.ndarray, m: int) -> np.ndarray:
    """32-bit hash of a context of predictor ``m``."""
    with np.errstate(over="ignore"):
        return (mix(x.astype(np.uint64) + np.uint64(m + 1) * MULT) >> np.uint64(32)).astype(np.uint32)


def _slot(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - SLOT_BITS)


class Decisions:
    """All decisions of some documents of a part: a slot in each predictor's table, the bit and the weight set."""

    def __init__(self, code: np.ndarray, row: np.ndarray, first: np.ndarray, novel: np.ndarray, widths: np.ndarray, huffman: Code):
        total = len(code)
        level, by_two, by_one = (code & 3).astype(np.int64), (code >> 2 & 15).astype(np.int64), (code >> 6 & 31).astype(np.int64)
        place = np.arange(total) - first[row]

        def back(x: np.ndarray, k: int, none: int) -> np.ndarray:
            return np.where(place >= k, np.r_[np.zeros(k, np.int64), x[:-k]][:total] if total > k else none, none)

        last, last2, last3 = (back(level, k, 4) for k in (1, 2, 3))
        history = last * 25 + last2 * 5 + last3
        rare = back(by_one, 1, 0)
        far = np.minimum(np.ceil(np.log2(place + 1.0)), 15).astype(np.int64)
        asked = [by_two > 0, (level >= 1) & (by_one > 0), level >= 2]
        # spelling
        word = np.flatnonzero(level == 3)
        begin = np.cumsum(widths) - widths
        k = np.arange(len(novel)) - np.repeat(begin, widths)
        body = np.flatnonzero(k >= BACK)
        n, node, bit = huffman.spread(novel[body])
        per_word = np.bincount(np.repeat(np.arange(len(widths)), widths)[body], weights=n, minlength=len(widths)).astype(np.int64)
        flags = sum(a.astype(np.int64) for a in asked)
        extra = np.zeros(total, np.int64)
        extra[word] = per_word
        self.per_token = flags + extra
        start = np.cumsum(self.per_token) - self.per_token
        self.total = int(self.per_token.sum())
        slots: list[list[np.ndarray]] = [[] for _ in range(MODELS)]
        places, bits, sets, tokens = [], [], [], []
        at = start.copy()
        for kind, (a, q) in enumerate(zip(asked, (by_two, by_one, by_one))):
            i = np.flatnonzero(a)
            places.append(at[i])
            at[i] += 1
            q, head, h, f, l = q[i], (kind + 1) * 8, history[i], far[i], last[i]
            for m, x in enumerate((q, h, q * 125 + h, q * 1024 + rare[i] * 32 + by_one[i], (f * 5 + l) * 5 + last2[i], (q * 16 + f) * 5 + l)):
                slots[m].append(_slot((x * 32 + (head + m)).astype(np.uint32)))
            bits.append(level[i] == kind)
            sets.append(2 * kind + (q > 3))
            tokens.append(i)
        if len(body):
            places.append(np.repeat(start[word] + flags[word] - (np.cumsum(per_word) - per_word), per_word) + np.arange(len(node)))
            so_far, prefix = np.uint64(0), []
            for j in range(BACK):
                so_far = so_far | novel[body - (j + 1)].astype(np.uint64) << np.uint64(8 * j)
                prefix.append(so_far)
            inside = np.minimum(k[body] - BACK, 15).astype(np.uint64)
            for m, x in enumerate((*prefix, prefix[0] << np.uint64(4) | inside)):
                slots[m].append(_slot(np.repeat(_scrambled(x, m), n) ^ node))
            bits.append(bit)
            sets.append(6 + np.repeat(inside > 0, n))
            tokens.append(np.repeat(word, per_word))
        #: In no order; ``place`` is where each stands in the stream, ``token`` what it belongs to.
        self.place, self.token = np.concatenate(places), np.concatenate(tokens)
        self.slots = [np.concatenate(x) for x in slots]
        self.bit, self.set = np.concatenate(bits).astype(np.int8), np.concatenate(sets).astype(np.int8)


def lanes(codes: np.ndarray, n_tokens: np.ndarray, novel: np.ndarray, widths: np.ndarray):
    """Slices of a part of about ``LANE_TOKENS`` tokens: (from document, to document, arguments of ``Decisions``)."""
    first = np.r_[0, np.cumsum(n_tokens)]
    spelled = np.r_[0, np.cumsum((codes & 3) == 3)]
    begin = np.r_[0, np.cumsum(widths)]
    i = 0
    while i < len(n_tokens):
        j = min(max(int(np.searchsorted(first, first[i] + LANE_TOKENS, "right")) - 1, i + 1), len(n_tokens))
        a, b = first[i], first[j]
        x, y = spelled[a], spelled[b]
        yield i, j, (codes[a:b], np.repeat(np.arange(j - i), n_tokens[i:j]), first[i:j] - a, novel[begin[x] : begin[y]], widths[x:y])
        i = j


def _rows(batches):
    """Parts of the written table."""
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            x = {k: b.column(j)[i] for j, k in enumerate(names)}
            lists = {k: np.asarray(x[k].values) for k in ("ids", "n_tokens", "n_known", "n_bytes", "base_sum", "bits", "novel_sizes")}
            yield x["part"].as_py(), lists, np.frombuffer(x["codes"].as_py(), np.uint16), np.frombuffer(x["novel"].as_py(), np.uint8)


# ---------------------------------------------------------------- tables
GATHERED = pa.schema([("key", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def _gather(huffman: Code):
    """Bit counts of a task's training documents, by predictor and range of slots."""

    def run(batches):
        size = 2 << SLOT_BITS
        counts = np.zeros((MODELS, size), np.int64)
        some = -1
        for part, x, codes, novel in _rows(batches):
            some = part
            train = ~is_held_out(x["ids"])
            for i, _, args in lanes(codes, x["n_tokens"], novel, x["novel_sizes"]):
                d = Decisions(*args, huffman)
                mine = train[i + args[1]][d.token]
                bit = d.bit[mine].astype(np.uint32)
                for m in range(MODELS):
                    counts[m] += np.bincount(d.slots[m][mine] * np.uint32(2) + bit, minlength=size)
        if some >= 0:
            rows = [(r, some, _planes(x)) for r, x in enumerate(counts.reshape(MODELS * RANGES, -1)) if x.any()]
            if rows:
                yield table(GATHERED, *map(list, zip(*rows)))

    return run


def _sum_tables(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(_unplanes(x).astype(np.int64) for x in pdf["data"])
    return pd.DataFrame({"key": [int(pdf["key"].iloc[0])], "data": [_planes(total)]})


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -7.9, 7.9).astype(np.float32)


class Mixer:
    """Predictions in steps of a sixteenth, and the online pass."""

    def __init__(self, huffman: Code, counts: np.ndarray):
        n0, n1 = counts[:, 0::2], counts[:, 1::2]
        self.huffman = huffman
        #: Per predictor: predictions from all counts, and without one occurrence of a 0 or of a 1.
        versions = [(n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))]
        self.steps = np.concatenate([np.round(stretched(a, b) * 16) for a, b in versions], 1).astype(np.int8)
        self.weights = np.full((SETS, MODELS), WEIGHT, np.float32)

    def inputs(self, d: Decisions, train: np.ndarray) -> np.ndarray:
        """Predictions (decision, predictor) as int8; ``train`` says whose own occurrence is in the counts."""
        shift = np.where(train, d.bit.astype(np.uint32) + np.uint32(1), np.uint32(0)) << np.uint32(SLOT_BITS)
        out = np.empty((d.total, MODELS), np.int8)
        for m in range(MODELS):
            out[:, m] = self.steps[m][d.slots[m] + shift]
        return out

    def score(self, x: np.ndarray, bit: np.ndarray, kind: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Bits that the decisions of each document (``per`` of them in a row) cost, learning block by block.

        All documents advance together, the longest first; a step is one slice.
        """
        n, total = len(per), len(bit)
        begin = np.cumsum(per) - per
        order = np.argsort(-per, kind="stable")
        blocks = -(-per[order] // BLOCK)
        lane = np.repeat(np.arange(n), blocks)
        step = np.arange(len(lane)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        by_step = np.argsort(step, kind="stable")
        lane, active = lane[by_step], np.bincount(step)
        first, stop = begin[order][lane] + step[by_step] * BLOCK, (begin + per)[order][lane]
        w = np.repeat(self.weights[None], n, 0).reshape(n * SETS, MODELS)
        bias, cost, done = np.zeros(n * BIASES, np.float32), np.zeros(n), 0
        sets, inside = np.arange(SETS, dtype=np.int8)[None, :, None], np.arange(BLOCK)
        for a in active.tolist():
            at = first[done : done + a, None] + inside
            live = (at < stop[done : done + a, None]).astype(np.float32)
            np.minimum(at, total - 1, out=at)
            done += a
            xs, k = x[at].astype(np.float32), kind[at]
            s = (bit[at] * 2 - 1).astype(np.float32)
            dot = np.einsum("abm,abm->ab", w[k + (np.arange(a) * SETS)[:, None]], xs)
            dot *= np.float32(1 / 16)
            np.clip(dot, -15.9, 15.9, out=dot)
            b = ((dot + 16) * np.float32(BIASES / 32)).astype(np.int64)
            b += (np.arange(a) * BIASES)[:, None]
            dot += bias[b]
            dot *= s
            q = np.exp(-dot)
            cost[:a] += (np.log1p(q) * live).sum(1)
            e = s * live * q / (1 + q)
            of = (k[:, None, :] == sets) * e[:, None, :]
            w[: a * SETS] += np.float32(RATE / 16) * (of @ xs).reshape(a * SETS, MODELS)
            bias[: a * BIASES] += BIAS_RATE / BLOCK * np.bincount(b.ravel(), weights=e.ravel(), minlength=a * BIASES).astype(np.float32)
        out = np.zeros(n)
        out[order] = cost / np.log(2)
        return out


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def _score(model, tokens: int):
    def run(batches):
        mixer: Mixer = model.value
        for _, x, codes, novel in _rows(batches):
            held, n = is_held_out(x["ids"]), x["n_tokens"]
            known = np.bincount(np.repeat(np.arange(len(n)), n), weights=(codes & 3) == 2, minlength=len(n))
            # all training tokens less the own ones, and the own ones so far: this many at most
            bits = x["bits"] + known * np.log2(np.maximum(tokens + np.where(held, n, 0), 1))
            made = []
            for i, j, args in lanes(codes, n, novel, x["novel_sizes"]):
                d = Decisions(*args, mixer.huffman)
                order = np.empty(d.total, np.int64)
                order[d.place] = np.arange(d.total)
                inputs = mixer.inputs(d, ~held[i + args[1]][d.token])
                made.append((inputs[order], d.bit[order], d.set[order], np.bincount(args[1], weights=d.per_token, minlength=j - i).astype(np.int64)))
            bits += mixer.score(*(np.concatenate(v) for v in zip(*made)))
            yield table(SCORES, x["ids"], held, n, x["n_known"], x["base_sum"], -bits * np.log10(2), x["n_bytes"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every document.

    Documents whose crc32 of the id modulo 10 is 0 are held out; all others train. ``base_score`` is the smoothed
    unigram score of the tokens (words and one end) from the counts of all training documents, the own included.
    ``score`` is the mixing model's log10 probability of the stream; of a training document it is what the rest of the
    corpus and the document's own beginning predict. ``bits_per_byte`` is the same per byte (each token and a byte).

    Counts of sequences stay distributed. What goes to every task is bounded: ``MODELS`` tables of 2**18 slots of bit
    counts and a Huffman code, gathered from all training documents. A null text is empty: one end
    token. Rows without an id are left out; repeated rows count one by one; without training documents all counts are
    0; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    buckets = max(1, -(-parts // 2))
    dealt = arrow_map(rows, _deal(parts), "part int, payload binary")
    asked = dealt.groupBy("part").applyInArrow(_ask(buckets), "kind int, bucket int, part int, keys binary, counts binary")
    answers = asked.groupBy("kind", "bucket").applyInPandas(_count, "part int, kind int, bucket int, data binary")
    coded = written(dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_coded(buckets), CODED_SQL), "coded")
    sums = coded.agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = sums[0] or 0, sums[1] or 0
    coded = coded.where("part >= 0")
    histogram = np.zeros(256, np.int64)
    for r in coded.select(F.posexplode("histogram").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[r.byte] = r.n
    huffman = Code(histogram)
    gathered = arrow_map(coded, _gather(huffman), "key int, part int, data binary")
    # hundreds of partial tables are added at a time, then their sums
    partial = gathered.groupBy("key", F.floor(F.col("part") / 128)).applyInPandas(_sum_tables, "key int, data binary")
    counts = np.zeros((MODELS * RANGES, (2 << SLOT_BITS) // RANGES), np.int64)
    for r in partial.groupBy("key").applyInPandas(_sum_tables, "key int, data binary").toLocalIterator():
        counts[r.key] = _unplanes(bytes(r.data))
    mixer = Mixer(huffman, counts.reshape(MODELS, -1))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, n_bytes long"
    scored = arrow_map(coded, _score(spark.sparkContext.broadcast(mixer), tokens), schema)
    norm = float(np.log10(tokens + 0.1 * (distinct + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * norm).alias("base_score"), "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
