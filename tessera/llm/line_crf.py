"""Quality rules: word and repetition counts, then a linear-chain CRF that labels each line content or boilerplate.

One pass over the texts leaves counts and, for each line, a feature mask and a hash. Lines that stand behind many
different lines somewhere in the corpus are widespread: navigation, licences, slogans. (Copies of a document don't make
its lines widespread, as each follows the same line in all of them.) The CRF has two labels, binary line features and a
2 x 2 transition matrix. Targets are per line: in a document of poor quality every line is boilerplate, in a good one
those that are widespread or repeat an earlier line; all others are content. It is fitted by gradient ascent on the
conditional likelihood of all pairs of neighbouring lines of all labelled documents, which come to the driver as counts
of (quality, mask, next mask). Viterbi decoding labels all lines of a document at once; the share of words in content
lines decides.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Chunk, arrow_map, chunks, mix, span_hash, table, unpacked, words, written

FEATURES = ("bias", "first", "short", "long", "ends_sentence", "some_symbols", "many_symbols", "pipes", "shouting", "shouted_words", "digits", "repeated", "few_distinct", "marked_words", "long_words", "widespread")
BIT = {name: i for i, name in enumerate(FEATURES)}
#: A line is widespread if it stands behind at least so many different lines.
WIDESPREAD = 5
#: At most so many lines count as hot, and those only from a thousand occurrences on.
HOT_LINES = 5000
#: Most distinct (quality, mask, next mask) that the fit takes, the most frequent first.
FIT_PAIRS = 200_000
WINDOW_CODES = np.random.default_rng(11).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


SYMBOL, MARK, STOP, PIPE = _mask(b"#*$%&|<>"), _mask(b"#*$%&|<>!=~_^"), _mask(b".!?"), _mask(b"|")
UPPER, LOWER, DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(bytes(range(48, 58)))


class Measured:
    """Counts per row and per line (lines without a word are left out) of a chunk."""

    def __init__(self, c: Chunk):
        data, offs, n = c.data, c.offs, len(c)
        size = len(data)

        def total(mask: np.ndarray) -> np.ndarray:
            return np.r_[0, np.cumsum(mask, dtype=np.int64)]

        start, end, row = words(data, offs)
        (w,) = span_hash(data, start, end)
        self.n_words = np.bincount(row, minlength=n)
        char = total((data & 0xC0) != 0x80)
        self.word_chars = np.bincount(row, weights=char[end] - char[start], minlength=n).astype(np.int64)
        symbols = total(SYMBOL[data])
        self.n_symbols = symbols[offs[1:]] - symbols[offs[:-1]]
        self.n_repeat = self._repeats(w, row, n)
        # lines
        breaks = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], breaks + 1]))
        begin = begin[begin < size]
        close = np.minimum(np.r_[begin[1:], size], size)
        close = close - (data[close - 1] == 10) if len(begin) else close
        line = np.searchsorted(begin, start, "right") - 1
        count = np.bincount(line, minlength=len(begin))
        has = count > 0
        index = np.cumsum(has) - 1
        begin, close, count, word_line = begin[has], close[has], count[has], index[line]
        self.line_row = np.searchsorted(offs, begin, "right") - 1
        self.line_words = count
        self.line_hash, check = span_hash(data, begin, close, 2)
        order = np.lexsort((check, self.line_hash, self.line_row))
        same = np.zeros(len(begin), bool)
        same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (self.line_hash, check, self.line_row)])
        dup = np.zeros(len(begin), bool)
        dup[order] = same
        self.n_dup_lines = np.bincount(self.line_row[dup], minlength=n)
        self.features = self._features(data, begin, close, count, dup, total, w, word_line, start, end)

    @staticmethod
    def _repeats(w: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        if len(w) < 5:
            return np.zeros(n, np.int64)
        with np.errstate(over="ignore"):
            g = np.zeros(len(w) - 4, np.uint64)
            for k in range(5):
                g += w[k : k + len(g)] * WINDOW_CODES[k]
            at = np.flatnonzero(row[:-4] == row[4:])
            key = mix(g[at] ^ mix(row[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        k = key[order]
        eq = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= eq
        twice[:-1] |= eq
        hit = at[order[twice]]
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + 5, -1)
        return np.bincount(row[np.cumsum(edge)[:-1] > 0], minlength=n)

    def _features(self, data, begin, close, count, dup, total, w, word_line, start, end) -> np.ndarray:
        def per_line(mask):
            t = total(mask[data])
            return t[close] - t[begin]

        m = len(begin)
        symbols, upper, lower, digit, pipes = (per_line(x) for x in (SYMBOL, UPPER, LOWER, DIGIT, PIPE))
        last = np.maximum(np.r_[0, np.cumsum(np.bincount(word_line, minlength=m))][1:] - 1, 0)
        final = data[end[last] - 1] if m else np.zeros(0, np.uint8)
        marked = np.bincount(word_line, weights=MARK[data[end - 1]], minlength=m) if m else np.zeros(0)
        capital = total(UPPER[data])
        small = total(LOWER[data])
        shouted = (capital[end] - capital[start] > 1) & (small[end] == small[start])
        shouts = np.bincount(word_line, weights=shouted, minlength=m)
        key = mix(w ^ mix(word_line.astype(np.uint64) + np.uint64(1)))
        distinct = np.bincount(word_line[np.unique(key, return_index=True)[1]], minlength=m)
        chars = np.maximum(close - begin, 1)
        flags = {
            "bias": np.ones(m, bool), "first": np.r_[True, self.line_row[1:] != self.line_row[:-1]][:m], "short": count <= 3, "long": count >= 12,
            "ends_sentence": STOP[final], "some_symbols": symbols >= 1, "many_symbols": symbols * 3 >= count, "pipes": pipes >= 2,
            "shouting": upper > lower, "shouted_words": shouts * 3 >= count, "digits": digit * 4 >= chars, "repeated": dup,
            "few_distinct": distinct * 5 < count * 3, "marked_words": marked * 2 >= count, "long_words": chars > 14 * count,
        }
        out = np.zeros(m, np.int32)
        for name, flag in flags.items():
            out |= flag.astype(np.int32) << BIT[name]
        return out


def unpack(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


# ---------------------------------------------------------------- CRF
class Crf:
    """Weights: emission (features x 2) and transition (2 x 2). Label 1 is content."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def viterbi(self, masks: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Best label of every line; lines are grouped by row in order. All rows advance together."""
        score = unpack(masks) @ self.emission
        lengths = np.bincount(row, minlength=n)
        first = np.r_[0, np.cumsum(lengths)][:-1]
        order = np.argsort(-lengths, kind="stable")
        length, first = lengths[order], first[order]
        back = np.zeros((len(masks), 2), np.int8)
        labels = np.zeros(len(masks), np.int8)
        active = int((length > 0).sum())
        best = score[first[:active]].copy()
        full = np.zeros((active, 2))
        t = 1
        while active:
            go = int(np.searchsorted(-length[:active], -t, "left"))  # rows with more than t lines
            full[go:active] = best[go:active]
            if not go:
                break
            step = best[:go, :, None] + self.transition
            at = first[:go] + t
            back[at] = step.argmax(1)
            best[:go] = step.max(1) + score[at]
            active, t = go, t + 1
        has = int((length > 0).sum())
        now = full[:has].argmax(1)
        at = first[:has] + length[:has] - 1
        left = length[:has].copy()
        while has:
            labels[at[:has]] = now[:has]
            now = back[at[:has], now[:has]]
            left = left[:has] - 1
            at = at[:has] - 1
            keep = left > 0
            if not keep.all():
                at, now, left = at[keep], now[keep], left[keep]
            has = len(at)
        return labels


def targets(quality: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """1 (content) for lines of good documents that are neither widespread nor repeated."""
    return ((quality > 0) & (mask & (1 << BIT["repeated"] | 1 << BIT["widespread"]) == 0)).astype(np.int64)


def fit(pairs: Counter, rounds: int = 500, rate: float = 1.0, decay: float = 1e-4) -> Crf:
    """Gradient ascent on the conditional log-likelihood of windows of two lines; deterministic.

    ``pairs`` counts (quality, mask, mask of the next line, or -1 behind a lone line). Without lines of both labels
    every line is content.
    """
    width = len(FEATURES)
    rows = np.array([(q, a, b) for q, a, b in pairs], np.int64).reshape(-1, 3)
    n = np.array(list(pairs.values()), np.float64)
    ya, yb, two = targets(rows[:, 0], rows[:, 1]), targets(rows[:, 0], np.maximum(rows[:, 2], 0)), rows[:, 2] >= 0
    seen = np.bincount(np.r_[ya, yb[two]], minlength=2)
    w, trans = np.zeros((width, 2)), np.zeros((2, 2))
    if not seen.all():
        w[0, 1] = 1.0
        return Crf(w, trans)
    xa, xb = unpack(rows[:, 1]), unpack(np.maximum(rows[:, 2], 0)) * two[:, None]
    n /= n.sum()
    truth = np.zeros((len(n), 2, 2))
    truth[np.arange(len(n)), ya, np.where(two, yb, 0)] = 1
    best, held = -np.inf, None
    for _ in range(rounds):
        score = (xa @ w)[:, :, None] + ((xb @ w)[:, None, :] + trans) * two[:, None, None]
        score[~two, :, 1] = -np.inf  # a lone line has one column
        top = score.max((1, 2), keepdims=True)
        p = np.exp(score - top)
        z = p.sum((1, 2), keepdims=True)
        value = float(n @ (np.where(truth > 0, score, 0).sum((1, 2)) - top.ravel() - np.log(z.ravel()))) - decay * float((w**2).sum() + (trans**2).sum()) / 2
        if value < best:  # too far: back, and on with half the step
            w, trans, step_w, step_t = held
            rate /= 2
        else:
            off = (truth - p / z) * n[:, None, None]
            step_w, step_t = xa.T @ off.sum(2) + xb.T @ off.sum(1) - decay * w, off[two].sum(0) - decay * trans
            best, held, rate = value, (w, trans, step_w, step_t), rate * 1.2
        w, trans = w + rate * step_w, trans + rate * step_t
    w, trans = held[:2]
    return Crf(w, trans)


# ---------------------------------------------------------------- operators
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), *((k, pa.int64()) for k in COUNTS), ("base_failed", pa.bool_()),
    ("masks", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("lines", pa.list_(pa.struct([("h", pa.int64()), ("p", pa.int32())]))),
])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row for each input row: its id, the MD5 of its text, counts, and its lines' masks and
    numbers of words. The bit of widespread lines is set from the whole of ``docs``."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            for c in chunks([b]):
                m = Measured(c)
                failed = (m.n_words < 10) | (100 * m.n_repeat > 20 * m.n_words)
                offs = pa.array(np.r_[0, np.cumsum(np.bincount(m.line_row, minlength=len(c)))], pa.int32())
                first = np.r_[True, m.line_row[1:] != m.line_row[:-1]][: len(m.line_row)]
                before = np.where(first, 0, np.r_[np.zeros(1, np.uint64), m.line_hash[:-1]][: len(first)]).astype(np.uint32).view(np.int32)
                line = pa.StructArray.from_arrays([pa.array(m.line_hash.view(np.int64)), pa.array(before)], ["h", "p"])
                lists = [pa.ListArray.from_arrays(offs, x) for x in (pa.array(m.features), pa.array(m.line_words.astype(np.int32)), line)]
                ids, key = b.column(2).slice(at, len(c)), b.column(3).slice(at, len(c))
                yield table(MEASURED, row + np.arange(len(c)), ids, key, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat, failed, *lists)
                row, at = row + len(c), at + len(c)

    text = F.col(text_col).cast("string")
    rows = docs.select(F.lit(0).cast("long").alias("no"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"))
    counts = ", ".join(f"{k} long" for k in COUNTS)
    schema = f"row long, doc_id long, key binary, {counts}, base_failed boolean, masks array<int>, words array<int>, lines array<struct<h:long,p:int>>"
    first = written(arrow_map(rows, run, schema), "measured")
    lines = first.select("row", F.posexplode("lines").alias("at", "line")).select("row", "at", "line.h", "line.p")
    # the lines at hand are many where a line is frequent: those few lines are broadcast, the others joined
    limit = max(1000, (first.agg(F.sum(F.size("lines"))).first()[0] or 0) // HOT_LINES)
    wide = lines.groupBy("h", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("behind"), F.sum("n").alias("n")).where(F.col("behind") >= WIDESPREAD)
    hot = F.broadcast(wide.where(F.col("n") >= limit).select("h", F.lit(True).alias("hot")))
    known = lines.select("row", "at", "h").join(hot, "h", "left")
    cold = known.where("hot is null").select("row", "at", "h").join(wide.where(F.col("n") < limit).select("h"), "h", "left_semi")
    marks = known.where("hot").select("row", "at").unionByName(cold.select("row", "at")).groupBy("row").agg(F.collect_list("at").alias("wide"))
    marked = first.drop("lines").join(marks, "row", "left")
    bit = F.lit(1 << BIT["widespread"])
    masks = F.when(F.col("wide").isNull(), F.col("masks")).otherwise(F.transform("masks", lambda m, i: F.when(F.array_contains("wide", i), m.bitwiseOR(bit)).otherwise(m)))
    return written(marked.withColumn("masks", masks).drop("wide"), "lines")


def fit_on(lines: DataFrame, labels: DataFrame) -> Crf:
    """Fit on all lines of all documents that ``labels`` (``doc_id, quality``) names; ``lines`` is from ``measured``.

    Of several labels of a document the least counts; null labels and null ids are left out. Only counts come to the
    driver, at most ``FIT_PAIRS`` of them.
    """
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    known = lines.where("size(masks) > 0").join(quality, "doc_id").select("quality", "masks", F.size("masks").alias("n"))
    nexts = F.expr("if(n = 1, array(-1), slice(masks, 2, n - 1))")
    both = known.select("quality", F.explode(F.arrays_zip(F.expr("slice(masks, 1, greatest(n - 1, 1))").alias("a"), nexts.alias("b"))).alias("x"))
    counted = both.groupBy("quality", F.col("x.a").alias("a"), F.col("x.b").alias("b")).count()
    return fit(Counter({(r.quality, r.a, r.b): r["count"] for r in counted.orderBy(F.desc("count"), "quality", "a", "b").limit(FIT_PAIRS).collect()}))


VERDICT = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_words", pa.int64()), ("key", pa.binary())])


def _verdicts(lines: DataFrame, crf: Crf, share: float) -> DataFrame:
    def run(batches):
        for b in batches:
            col = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            offs = col["masks"].offsets.to_numpy().astype(np.int64)
            masks = col["masks"].flatten().to_numpy(zero_copy_only=False)
            words_ = col["words"].flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            label = crf.viterbi(masks, row, len(offs) - 1)
            content = np.bincount(row, weights=words_ * label, minlength=len(offs) - 1).astype(np.int64)
            kept = ~col["base_failed"].to_numpy(zero_copy_only=False) & (content >= share * col["n_words"].to_numpy(zero_copy_only=False))
            yield table(VERDICT, col["doc_id"], *(col[k] for k in COUNTS), col["base_failed"], kept, content, col["key"])

    counts = ", ".join(f"{k} long" for k in COUNTS)
    return arrow_map(lines, run, f"doc_id long, {counts}, base_failed boolean, kept boolean, content_words long, key binary")


def verdicts(docs: DataFrame, labels: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, ``base_failed``, ``kept`` and ``content_words``.

    ``kept`` needs the base rules (at least 10 words, at most 20 % of them in repeated 5-word windows) and at least
    ``share`` of the words in lines that the CRF marks as content. Null, empty and blank texts have no words and fail
    the base; rows without an id are left out of the result (their lines count); repeated rows are judged one by one;
    without labels of both kinds every line is content; an empty table gives no rows; other columns are ignored.
    """
    lines = measured(docs, id_col, text_col)
    return _verdicts(lines.where("doc_id is not null"), fit_on(lines, labels), share).drop("key")


def drop_rejected(docs: DataFrame, labels: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows whose text the rules or the CRF reject; all columns stay.

    Equal texts have equal verdicts, so rows are matched by the MD5 of their text and not by id: rows without an id,
    and rows that repeat an id with another text, are judged by their own text. Null, empty and blank texts go, as
    they fail the base; an empty table stays empty; without labels only the base rules reject.
    """
    lines = measured(docs, id_col, text_col)
    rejected = _verdicts(lines, fit_on(lines, labels), share).where(~F.col("kept")).select("key").distinct()
    keyed = docs.select(F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"), F.struct("*").alias("row"))
    return unpacked(keyed.join(rejected, "key", "left_anti"), docs)
