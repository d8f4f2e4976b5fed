"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Pieces (matches of the split pattern) of about the same length form the rows of one padded matrix of ids. Each round
every row merges its leftmost pair of least rank; ranks of pairs come from a hash table in numpy arrays. A row loses
one column a round, so the matrix is compacted by one boolean selection; rows without a pair left leave it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, chunks, table

NONE = np.int32(2**31 - 1)
#: A row costs its width squared; longer pieces are merged in the same order through a heap.
LONGEST_ROW = 1024


class PairTable:
    """(left id, right id) -> rank of the merged token, by open addressing in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        k, v = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(10, int(len(k)).bit_length() + 2)
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, NONE)
        slot = self._slot(k)
        left = np.arange(len(k))
        while len(left):  # one winner for each free slot, the others try the next
            at = slot[left]
            free = self.keys[at] == np.uint64(2**64 - 1)
            cand, where = left[free], at[free]
            self.keys[where] = k[cand]
            won = self.keys[where] == k[cand]
            self.values[where[won]] = v[cand[won]]
            lost = np.concatenate([left[~free], cand[~won]])
            slot[lost] = (slot[lost] + 1) & (size - 1)
            left = lost

    def _slot(self, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint32).astype(np.uint64)
        slot = self._slot(k)
        found = self.keys[slot]
        out = np.where(found == k, self.values[slot], NONE)
        open_ = np.flatnonzero((found != k) & (found != np.uint64(2**64 - 1)))
        mask = (1 << self.bits) - 1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found = self.keys[slot[open_]]
            hit = found == k[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out


class ByteBpe:
    def __init__(self, path: str, pattern: str | None = None, keep: int = 800_000):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(self.ranks)
        self.known: dict[str, bytes] = {}
        self.keep = keep

    # -------------------------------------------------------- pieces
    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece: a piece that is a token itself is that token, others are merged."""
        out: list = [None] * len(pieces)
        rest: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONGEST_ROW:
                out[i] = self._by_heap(p)
            else:
                rest.setdefault(max(2, (len(p) + 3) // 4), []).append(i)
        for bucket in rest.values():
            for k in range(0, len(bucket), 1 << 14):
                self._by_matrix(pieces, bucket[k : k + (1 << 14)], out)
        return out

    def _by_matrix(self, pieces: list[bytes], rows: list[int], out: list) -> None:
        n = np.array([len(pieces[i]) for i in rows])
        width = int(n.max())
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        ids = self.single[raw]
        pad = np.arange(width) >= n[:, None]
        ids[pad] = -1
        ranks = np.full((len(rows), max(1, width - 1)), NONE)
        live = ~pad[:, 1:]
        ranks[live] = self.pairs.lookup(ids[:, :-1][live], ids[:, 1:][live])
        who = np.array(rows)
        while len(who):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(who)), at]
            over = best == NONE
            if over.any():
                for r in np.flatnonzero(over):
                    out[who[r]] = ids[r, : n[r]].copy()
                go = ~over
                who, ids, ranks, n, at, best = who[go], ids[go], ranks[go], n[go], at[go], best[go]
                if not len(who):
                    break
            i = np.arange(len(who))
            ids[i, at] = best
            w = ids.shape[1]
            keep = np.ones((len(who), w), bool)
            keep[i, at + 1] = False
            ids = ids[keep].reshape(len(who), w - 1)
            n = n - 1
            keep = np.ones(ranks.shape, bool)
            keep[i, at] = False
            ranks = ranks[keep].reshape(len(who), w - 2)
            if ranks.shape[1] == 0:
                for r in i:
                    out[who[r]] = ids[r, : n[r]].copy()
                break
            right = at < n - 1
            ranks[i[right], at[right]] = self.pairs.lookup(ids[i[right], at[right]], ids[i[right], at[right] + 1])
            edge = ~right & (at < ranks.shape[1])
            ranks[i[edge], at[edge]] = NONE
            left = at > 0
            ranks[i[left], at[left] - 1] = self.pairs.lookup(ids[i[left], at[left] - 1], ids[i[left], at[left]])

    def _by_heap(self, piece: bytes) -> np.ndarray:
        """The same merges for very long pieces, in n log n."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get, tokens = self.ranks.get, self.tokens
        first = [get(piece[i : i + 2]) for i in range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                q = get(tokens[r] + tokens[ids[nxt[i]]])
                if q is not None:
                    heapq.heappush(heap, (q, i, r, ids[nxt[i]]))
            p = prv[i]
            if p >= 0:
                q = get(tokens[ids[p]] + tokens[r])
                if q is not None:
                    heapq.heappush(heap, (q, p, ids[p], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    # -------------------------------------------------------- texts
    def learn(self, pieces) -> None:
        """Remember the packed ids of the pieces that are not known yet."""
        new = list({p for p in pieces if p not in self.known})
        if not new:
            return
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        got = self.encode_pieces(raw)
        raw = np.concatenate(got).astype("<u4").tobytes()
        end = np.cumsum([4 * len(g) for g in got]).tolist()
        self.known.update(zip(new, (raw[a:b] for a, b in zip([0, *end], end))))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian uint32 ids of each text."""
        if len(self.known) > self.keep:
            self.known = {}
        find, out = self.pattern.findall, []
        split = [find(t) for t in texts]
        self.learn({p for s in split for p in s})
        get = self.known.__getitem__
        for s in split:
            out.append(b"".join(map(get, s)))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MODELS: dict[str, ByteBpe] = {}


def model(path: str) -> ByteBpe:
    if path not in _MODELS:
        _MODELS[path] = ByteBpe(path)
    return _MODELS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens array<int>`` of every whole text.

    Null and empty texts give an empty list; rows without an id are left out; rows that repeat are encoded one by one;
    an empty table gives no rows; other columns are ignored. The same holds for ``decode`` and ``digests``.
    """
    path = vocabulary or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batches):
        bpe = model(path)
        for c in chunks(batches):
            raw = bpe.encode_all(c.texts())
            offs = np.r_[0, np.cumsum([len(x) // 4 for x in raw])]
            yield table(schema, c.ids, pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))))

    return arrow_map(_rows(docs, id_col, text_col), run, "doc_id long, tokens array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, tokens``."""
    path = vocabulary or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        bpe = model(path)
        for b in batches:
            lists = b.column(1).to_pylist()
            yield table(schema, b.column(0), [bpe.decode(np.asarray(x or [], "<u4").tobytes()) for x in lists])

    return arrow_map(tokens, run, "doc_id long, bytes binary")


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    path = vocabulary or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = model(path)
        for c in chunks(batches):
            raw = bpe.encode_all(c.texts())
            yield table(schema, c.ids, [len(x) // 4 for x in raw], [hashlib.sha256(x).hexdigest() for x in raw], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in raw])

    return arrow_map(_rows(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
