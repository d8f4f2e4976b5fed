"""Edit-aware token counts: a segment tree of pre-tokens per document, of which an edit re-encodes only what it touches.

``build_trees`` keeps the leaves of every document's tree as a table, ``apply_edits`` takes such a table and a table of
edits and gives the table after them; only documents with edits are touched, and of those only the pre-tokens around
the edits are encoded. ``edit_counts`` does both in one pass over the texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import byte_bpe
from tessera.llm.common import arrow_map, chunks, table

LEAF = 32
#: Leaves that hold more than this on average are dealt anew, with all others.
MOST = 128
#: The split pattern looks at fewer characters than this behind a match.
AHEAD = 4
#: What follows a pre-token can change it up to here: of a run of spaces the last one goes to the word behind it
#: (``\s+(?!\S)``), and a mark before two letters can be a contraction. Both look one character past the next one.
BACK = 2


class TokenTree:
    """Pre-tokens of one text in leaves of about ``LEAF``; inner nodes hold sums of characters and of tokens.

    ``replace`` starts at the pre-token that holds the character ``BACK`` before the edit (the split pattern looks that
    far ahead and never back, so earlier pre-tokens can't change) and stops at the first old boundary behind
    the edit that the new split meets again. Only those pre-tokens are encoded anew, and no more of the text is read
    than the leaves they are in. When what comes in no longer fits the leaves that it replaces, the leaves are dealt
    anew, without encoding anything.
    """

    def __init__(self, pieces: list[str], bpe: byte_bpe.ByteBpe, counts: list[int] | None = None):
        self.bpe, self.reencoded = bpe, 0
        self._build(pieces, self._counts(pieces) if counts is None else counts)

    def _build(self, pieces: list[str], counts: list[int]) -> None:
        """Leaves as two lists, of pre-tokens and of their numbers of tokens; then the sums."""
        self.leaves = [(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i in range(len(self.leaves)):
            self._sum(i)
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def _counts(self, pieces: list[str]) -> list[int]:
        known = self.bpe.known
        try:
            return [len(known[p]) >> 2 for p in pieces]
        except KeyError:
            self.bpe.learn(pieces)
            return [len(known[p]) >> 2 for p in pieces]

    def _sum(self, leaf: int) -> None:
        pieces, counts = self.leaves[leaf]
        self.chars[self.size + leaf], self.tokens[self.size + leaf] = len("".join(pieces)), sum(counts)

    def _pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def pieces(self) -> tuple[list[str], list[int]]:
        return [p for leaf, _ in self.leaves for p in leaf], [n for _, leaf in self.leaves for n in leaf]

    @property
    def text(self) -> str:
        return "".join(p for leaf, _ in self.leaves for p in leaf)

    def prefix_count(self, position: int) -> int:
        """Tokens of the pre-tokens that end at or before a character position."""
        leaf, start = self._find(position)
        total, i = 0, self.size + leaf
        while i > 1:
            if i & 1:
                total += self.tokens[i - 1]
            i >>= 1
        for p, t in zip(*self.leaves[leaf]):
            start += len(p)
            if start > position:
                break
            total += t
        return total

    def _find(self, position: int) -> tuple[int, int]:
        """Leaf that holds a character, and the leaf's first character."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if position >= start + self.chars[i] and i + 1 < 2 * self.size and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def replace(self, start: int, length: int, new: str) -> None:
        start = min(max(start, 0), self.chars[1])
        end = min(start + max(length, 0), self.chars[1])
        first, at = self._find(max(start - BACK, 0))
        old, sizes = self.leaves[first]
        ends = list(accumulate(map(len, old), initial=at))  # old positions of the boundaries
        k = max(bisect_right(ends, start - BACK) - 1, 0)
        at, ends, window, counts, last = ends[k], ends[k:], old[k:], sizes[k:], first + 1
        need = end + 64
        while True:
            while ends[-1] < need and last < len(self.leaves):
                more, sizes_ = self.leaves[last]
                ends += list(accumulate(map(len, more), initial=ends[-1]))[1:]
                window, counts, last = window + more, counts + sizes_, last + 1
            stop = min(bisect_left(ends, need) + 1, len(window))  # no more of the last leaf than is needed
            whole = last == len(self.leaves) and stop == len(window)
            was = "".join(window[:stop])
            now = was[: start - at] + new + was[end - at :]
            shift, behind = at + (end - start) - len(new), start - at + len(new)  # old position = new one + shift
            fresh, pos, kept = [], 0, None
            for m in self.bpe.pattern.finditer(now):
                if pos >= behind:
                    kept = bisect_left(ends, pos + shift)
                    if ends[kept] == pos + shift:
                        break
                    kept = None
                if m.end() > len(now) - AHEAD and not whole:
                    break
                fresh.append(m.group())
                pos = m.end()
            else:
                kept = len(window) if whole else None
            if kept is not None:
                break
            need += 2 * (need - at) + 64
        self.reencoded += len(fresh)
        pieces, numbers = old[:k] + fresh + window[kept:], sizes[:k] + self._counts(fresh) + counts[kept:]
        room = last - first
        if len(pieces) > MOST * room:
            before, after = self.leaves[:first], self.leaves[last:]
            self._build([p for x, _ in before for p in x] + pieces + [p for x, _ in after for p in x], [n for _, x in before for n in x] + numbers + [n for _, x in after for n in x])
            return
        share = max(1, -(-len(pieces) // room))
        for i in range(room):
            self.leaves[first + i] = pieces[i * share : (i + 1) * share], numbers[i * share : (i + 1) * share]
            self._sum(first + i)
        for i in {(self.size + first + j) >> 1 for j in range(room)} if room > 1 else ((self.size + first) >> 1,):
            while i:
                self._pull(i)
                i >>= 1


#: What the masking edits replace: e-mail addresses, runs of three or more digits, runs of a mark.
ADDRESS = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+")
MASKED = re.compile(r"[0-9]{3,}|([*$%&#|!])\1{2,}")
NUMBERS = re.compile(r"[0-9]{3,}")
RUNS = [c * 3 for c in "*$%&#|!"]


def masking_edits(text: str, mask: str = " <masked> ") -> list[tuple[int, int, str]]:
    """(start, length, replacement), last place first, so that earlier positions hold."""
    found = [m.span() for m in (MASKED if any(r in text for r in RUNS) else NUMBERS).finditer(text)]
    if "@" in text:
        whole = [m.span() for m in ADDRESS.finditer(text)]
        found = sorted(whole + [f for f in found if not any(a < f[1] and f[0] < b for a, b in whole)])
    return [(a, b - a, mask) for a, b in reversed(found)]


ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_pieces", pa.int64()), ("n_reencoded", pa.int64()), ("edited_sha256", pa.string())])


def _given(edits: list | None) -> list[tuple[int, int, str]]:
    """Edits of one row; those that are null or lack a start are none, a null length is 0, a null replacement empty."""
    return [(e["start"], e["length"] or 0, e["replacement"] or "") for e in edits or [] if e is not None and e["start"] is not None]


def edit_counts(docs: DataFrame, edits=masking_edits, edits_col: str | None = None, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text before and after its edits.

    Edits are what the function ``edits`` gives for a text, or the rows of ``edits_col``
    (``array<struct<start,length,replacement>>``, applied in order, positions in characters of the text as it then
    is; beyond its end they are moved to it; null edits, and edits without a start, are none). Returns ``doc_id,
    n_tokens, n_edits, n_tokens_edited, n_pieces, n_reencoded, edited_sha256``. Null and empty texts count 0 tokens;
    rows without an id are left out; rows that repeat an id are counted one by one, each with its own edits; an empty
    table gives no rows; other columns are ignored.
    """
    path = vocabulary or byte_bpe.default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(edits_col).alias("edits")] if edits_col else []))
    rows = rows.where("doc_id is not null")

    def run(batches):
        bpe = byte_bpe.model(path)
        for b in batches:
            given = b.column(2).to_pylist() if edits_col else None
            at = 0
            for c in chunks([b]):
                if len(bpe.known) > bpe.keep:
                    bpe.known = {}
                cols: list[list] = [[] for _ in ARROW]
                texts = c.texts()
                split = [bpe.pattern.findall(t) for t in texts]
                bpe.learn({p for s in split for p in s})
                get = bpe.known.__getitem__
                for i, (doc, text, pieces) in enumerate(zip(c.ids.tolist(), texts, split)):
                    todo = edits(text) if given is None else _given(given[at + i])
                    if todo:
                        tree = TokenTree(pieces, bpe)
                        before = tree.count
                        for start, length, new in todo:
                            tree.replace(start, length, new)
                        after, again, text = tree.count, tree.reencoded, tree.text
                    else:
                        before = after = sum(map(len, map(get, pieces))) >> 2
                        again = 0
                    for col, v in zip(cols, (doc, before, len(todo), after, len(pieces), again, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())):
                        col.append(v)
                at += len(c)
                yield table(ARROW, *cols)

    return arrow_map(rows, run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_pieces long, n_reencoded long, edited_sha256 string")


# ---------------------------------------------------------------- kept trees
TREES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
TREES_SQL = "doc_id long, text string, chars array<int>, tokens array<int>"


def build_trees(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, chars, tokens``: the leaves of every document's tree, as sizes of its pre-tokens in characters and tokens.

    The sums of inner nodes follow from them without encoding. Null texts are empty; rows without an id are left out;
    an empty table gives no rows. Write the result where it is to be kept.
    """
    path = vocabulary or byte_bpe.default_path()

    def run(batches):
        bpe = byte_bpe.model(path)
        for c in chunks(batches):
            if len(bpe.known) > bpe.keep:
                bpe.known = {}
            texts = c.texts()
            split = [bpe.pattern.findall(t) for t in texts]
            bpe.learn({p for s in split for p in s})
            size = {p: len(bpe.known[p]) >> 2 for s in split for p in s}
            yield table(TREES, c.ids, texts, [list(map(len, s)) for s in split], [[size[p] for p in s] for s in split])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, TREES_SQL)


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The table of ``build_trees`` after ``edits`` (``doc_id, edits``; as ``edits_col`` of ``edit_counts``), and ``n_reencoded``.

    Documents without edits pass through. ``edits`` has a row per document at most; edits of unknown documents are
    ignored.
    """
    path = vocabulary or byte_bpe.default_path()
    schema = pa.schema([*TREES, ("n_reencoded", pa.int64())])

    def run(batches):
        bpe = byte_bpe.model(path)
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, text, chars, tokens, todo in zip(*(b.column(i).to_pylist() for i in range(5))):
                stop = np.cumsum(chars, dtype=np.int64).tolist()
                tree = TokenTree([text[x:y] for x, y in zip([0, *stop], stop)], bpe, tokens)
                for start, length, new in _given(todo):
                    tree.replace(start, length, new)
                pieces, counts = tree.pieces
                for col, v in zip(cols, (doc, "".join(pieces), list(map(len, pieces)), counts, tree.reencoded)):
                    col.append(v)
            yield table(schema, *cols)

    joined = trees.select("doc_id", "text", "chars", "tokens").join(edits.select("doc_id", "edits"), "doc_id", "left")
    touched = arrow_map(joined.where("size(edits) > 0"), run, TREES_SQL + ", n_reencoded long")
    same = joined.where("edits is null or size(edits) = 0").select("doc_id", "text", "chars", "tokens", F.lit(0).cast("long").alias("n_reencoded"))
    return same.unionByName(touched)


def tree_counts(trees: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` from a table of trees."""
    return trees.select("doc_id", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))
