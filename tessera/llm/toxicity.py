"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon of whole words and of beginnings of words is learnt from the labelled texts: how many of the toxic and of the
clean ones hold each. A text's features are densities of that lexicon, plain and behind letters
written as digits or signs, how near its words stand to a second person, and rates of capitals, punctuation and
disguised words. Labelled texts see a lexicon that their own fold had no part in. Trees are fitted on three folds and
calibrated on the fourth; scoring is one pass over the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TO_LOWER, Chunk, arrow_map, chunks, span_hash, table, words, written

FOLDS = 4
#: Entries of the lexicon at most: the ones with the highest lower bounds.
LEXICON = 8192
#: Labelled rows of the fit: all up to so many, beyond that the share of them that a hash of the id picks.
FIT_ROWS = 200_000
#: A lexicon entry is in so many toxic texts at least, and its log-odds less two deviations are above this.
SUPPORT = 3
LEAST = 0.5
#: Bytes of the beginnings of words that are counted beside whole words.
BEGINNINGS = (4, 5, 6)
NEAR = 5
#: Words of the second person in English, German, French and Spanish.
SECOND = "you your yours yourself u ur du dich dir dein deine deinen deiner euch euer ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros"
#: Signs that stand for letters.
LEET = dict(zip("013457@$!|+", "oieastasilt"))
FEATURES = (
    "log_words", "lexicon_density", "lexicon_sum", "lexicon_hits", "lexicon_best", "hit_density", "second_density", "near_density", "near_hits",
    "capitals", "shouted", "exclaimed", "punctuation", "repeated_marks", "disguised", "disguised_density", "line_length", "word_length",
)

_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_PLAIN = TO_LOWER.copy()
for _a, _b in LEET.items():
    _PLAIN[ord(_a)] = ord(_b)
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "0123456789@$!|+*#"]] = True
_KINDS = np.random.default_rng(41).integers(1, 1 << 63, len(BEGINNINGS) + 1, dtype=np.uint64)


# ---------------------------------------------------------------- words and keys
def _bare(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words of a chunk, without the marks at their ends; words of marks only stay whole."""
    start, end, row = words(c.data, c.offs)
    letters = np.concatenate([[0], np.cumsum(~_PUNCT[c.data])])
    some = letters[end] > letters[start]
    at = np.flatnonzero(~_PUNCT[c.data])
    if len(at):
        first = at[np.minimum(letters[start], len(at) - 1)]
        last = at[np.maximum(letters[end] - 1, 0)] + 1
        start, end = np.where(some, first, start), np.where(some, last, end)
    return start, end, row


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For whole words and each length of a beginning: which words have it, and its hash."""
    out = [(np.arange(len(start)), span_hash(data, start, end)[0] ^ _KINDS[0])]
    for k, n in enumerate(BEGINNINGS, 1):
        who = np.flatnonzero(end - start > n)
        out.append((who, span_hash(data, start[who], start[who] + n)[0] ^ _KINDS[k]))
    return out


COUNTS = pa.schema([("key", pa.binary()), ("fold", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())])


def _count(batches):
    """Rows (fold * 2 + toxic, text): in how many texts of each fold and class each key stands. Keys are the bytes of a
    word, or of a beginning and ``*``."""
    for c in chunks(batches, 4 << 20):
        data = TO_LOWER[c.data]
        start, end, row = _bare(c)
        for k, (who, h) in enumerate(_hashes(data, start, end)):
            if not len(who):
                continue
            order = np.lexsort((row[who], h))
            h, r, w = h[order], row[who][order], who[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
            h, kind, w = h[new], c.ids[r[new]], w[new]  # one of each text
            order = np.lexsort((kind, h))
            h, kind, w = h[order], kind[order], w[order]
            at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])])
            n = np.diff(np.r_[at, len(h)])
            raw = data.tobytes()
            s, stop = start[w[at]].tolist(), (end[w[at]] if not k else start[w[at]] + BEGINNINGS[k - 1]).tolist()
            mark = b"*" if k else b""
            yield table(COUNTS, pa.array([raw[a:b] + mark for a, b in zip(s, stop)], pa.binary()), (kind[at] >> 1).astype(np.int32), (kind[at] & 1).astype(np.int32), n)


# ---------------------------------------------------------------- lexicon
@dataclass
class Lexicon:
    """Hashes in ascending order, and the weights of what they stand for."""

    hashes: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, entries: list[tuple[bytes, float]]) -> Lexicon:
        hashes = np.zeros(len(entries), np.uint64)
        for i, (key, _) in enumerate(entries):
            k = BEGINNINGS.index(len(key) - 1) + 1 if key.endswith(b"*") and len(key) - 1 in BEGINNINGS else 0
            text = np.frombuffer(key[:-1] if k else key, np.uint8)
            hashes[i] = span_hash(text, np.array([0]), np.array([len(text)]))[0][0] ^ _KINDS[k]
        order = np.argsort(hashes)
        return cls(hashes[order], np.array([w for _, w in entries], np.float64)[order])

    def weigh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The weight of each word: the largest of what it is and of how it begins; 0 for most."""
        out = np.zeros(len(start))
        if not len(self.hashes):
            return out
        for who, h in _hashes(data, start, end):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            out[who[hit]] = np.maximum(out[who[hit]], self.weights[at[hit]])
        return out


def lexicon(texts: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Counts ``key, t<fold>, c<fold>`` of the keys that could enter any lexicon, and the texts of each (fold, class).

    ``texts`` has ``kind`` (fold * 2 + class) and ``text``. Counts are over all texts, pre-aggregated in each task.
    """
    sizes = {(r.kind >> 1, r.kind & 1): r["count"] for r in texts.groupBy("kind").count().collect()}
    counts = arrow_map(texts.select("kind", "text"), _count, "key binary, fold int, toxic int, n long")
    columns = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"{'ct'[t]}{f}") for f in range(FOLDS) for t in (0, 1)]
    return counts.groupBy("key").agg(*columns).where(sum(F.col(f"t{f}") for f in range(FOLDS)) >= SUPPORT), sizes


def _entries(counts: DataFrame, sizes: dict[tuple[int, int], int], without: int | None) -> list[tuple[bytes, float]]:
    """The lexicon that all folds but ``without`` give: log-odds less two deviations, the highest ``LEXICON`` of them."""
    folds = [f for f in range(FOLDS) if f != without]
    toxic, clean = (sum((F.col(f"{k}{f}") for f in folds), F.lit(0)) for k in "tc")
    texts = [sum(sizes.get((f, t), 0) for f in folds) for t in (0, 1)]
    odds = F.log((toxic + 0.5) / (texts[1] + 1.0)) - F.log((clean + 0.5) / (texts[0] + 1.0))
    weight = odds - 2 * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    rows = counts.where(toxic >= SUPPORT).select("key", weight.alias("w")).where(F.col("w") > LEAST).orderBy(F.desc("w"), "key").limit(LEXICON).collect()
    return [(bytes(r.key), r.w) for r in rows]


# ---------------------------------------------------------------- features
_YOU = Lexicon.of([(w.encode(), 1.0) for w in SECOND.split()])


def features(c: Chunk, lexicon_: Lexicon) -> np.ndarray:
    """A row of ``FEATURES`` for each text of a chunk; zeros where a text has no words."""
    n = len(c)
    data = TO_LOWER[c.data]
    start, end, row = _bare(c)

    def rows(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values, n)

    def within(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[b] - total[a]).astype(np.float64)

    n_words = np.bincount(row, minlength=n).astype(np.float64)
    weight = lexicon_.weigh(data, start, end)
    letters, upper = within(_LETTER[c.data], start, end), within(_UPPER[c.data], start, end)
    odd = np.flatnonzero((letters > 0) & (within(_SIGN[c.data], start, end) > 0))
    hidden = np.zeros(len(start))
    hidden[odd] = lexicon_.weigh(_PLAIN[c.data], start[odd], end[odd])
    weight = np.maximum(weight, hidden)
    hit = weight > 0
    h = span_hash(data, start, end)[0] ^ _KINDS[0]
    you = _YOU.hashes[np.minimum(np.searchsorted(_YOU.hashes, h), len(_YOU.hashes) - 1)] == h
    # distance in words to the nearest second person of the same text
    at, far = np.arange(len(start)), 1 << 40
    before = np.maximum.accumulate(np.where(you, at, -far)) if len(at) else at
    behind = np.minimum.accumulate(np.where(you, at, far)[::-1])[::-1] if len(at) else at
    same_before = (before >= 0) & (row[np.maximum(before, 0)] == row) if len(at) else hit
    same_behind = (behind < far) & (row[np.minimum(behind, len(at) - 1)] == row) if len(at) else hit
    near = hit & ((same_before & (at - before <= NEAR)) | (same_behind & (behind - at <= NEAR)))
    a, b = c.offs[:-1], c.offs[1:]
    size = np.maximum((b - a).astype(np.float64), 1)
    mark = _PUNCT[c.data]
    again = np.zeros(len(data), bool)
    again[1:] = mark[1:] & (c.data[1:] == c.data[:-1])
    best = np.zeros(n)
    np.maximum.at(best, row[hit], weight[hit])
    some, all_letters = np.maximum(n_words, 1), np.maximum(within(_LETTER[c.data], a, b), 1)
    lines = within(c.data == 10, a, b) + 1
    hits, nears = rows(hit), rows(near)
    out = [
        np.log1p(n_words), rows(weight) / some, np.log1p(rows(weight)), np.log1p(hits), best, hits / some, rows(you) / some, nears / some, np.log1p(nears),
        within(_UPPER[c.data], a, b) / all_letters, rows((letters > 1) & (upper == letters)) / some, within((c.data == 33) | (c.data == 63), a, b) / size, within(mark, a, b) / size, within(again, a, b) / size,
        np.bincount(row[odd], minlength=n) / some, rows(hidden) / some, np.log1p(some / lines), rows((end - start).astype(np.float64)) / some,
    ]
    return np.stack(out, 1)


FEATURE_ROWS = pa.schema([("id", pa.int64()), ("features", pa.list_(pa.float64()))])


def feature_rows(rows: DataFrame, lexicons: list[Lexicon], by_kind: bool = False) -> DataFrame:
    """``id, features`` of rows (id, text); with ``by_kind`` the id is fold * 2 + class and picks the lexicon."""

    def run(batches):
        for c in chunks(batches):
            x = np.zeros((len(c), len(FEATURES)))
            which = c.ids >> 1 if by_kind else np.zeros(len(c), np.int64)
            for f in np.unique(which).tolist():
                mine = np.flatnonzero(which == f)
                found = features(c, lexicons[f])
                x[mine] = found[mine]
            yield pa.RecordBatch.from_arrays([pa.array(c.ids), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())], schema=FEATURE_ROWS)

    return arrow_map(rows, run, "id long, features array<double>")


# ---------------------------------------------------------------- model
def held_out(id_: Column) -> Column:
    """Rows whose labels are never looked at: CRC-32 of the id in decimals leaves 2 when divided by 4."""
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    lexicon: Lexicon
    trees: object | None
    calibration: object | None
    rate: float

    def score(self, rows: DataFrame) -> DataFrame:
        """Scores of ``feature_rows``, as ``id, score``: the calibrated share of toxic texts; texts that share a step of
        the calibration stay in the order of the trees by a thousandth."""
        if self.trees is None:
            return rows.select("id", F.lit(self.rate).alias("score"))
        out = self.trees.transform(rows.select("id", array_to_vector("features").alias("features")))
        out = out.select("id", vector_to_array("probability")[1].alias("p"))
        if self.calibration is None:
            return out.select("id", F.col("p").alias("score"))
        out = self.calibration.transform(out)
        return out.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("share") + 0.001 * F.col("p"))).alias("score"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_ROWS) -> DataFrame:
    """``kind, text``: each labelled text once (rows that repeat its id and text: as often), with its fold (by the text's
    digest) and class (the majority's).

    Held-out rows are left out before anything is joined. The labels that are used number about ``most`` at most, so they,
    and then one row for each different text, are broadcast: no text is shuffled or written, it is read once more
    where it is needed.
    """
    told = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col).cast("long"))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y"))
    number = told.count()
    if number > most:
        told = told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * most / number))
    told = written(told.groupBy("id").agg(F.avg("y").alias("y")), "labels")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(~held_out(F.col("id")))
    digests = rows.join(F.broadcast(told), "id").select("id", F.unhex(F.md5("text")).alias("h"), "y")
    fold = F.pmod(F.xxhash64("h"), F.lit(FOLDS)) * 2
    texts = written(digests.groupBy("h").agg(F.min("id").alias("id"), F.avg("y").alias("y")).select("id", "h", (fold + F.when(F.col("y") >= 0.5, 1).otherwise(0)).cast("long").alias("kind")), "texts")
    found = rows.join(F.broadcast(texts), "id").where(F.unhex(F.md5("text")) == F.col("h"))
    return found.select("kind", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", trees: int = 16, depth: int = 4) -> Model:
    """Lexicon, trees and calibration from the labelled rows that aren't held out (see ``FIT_ROWS``).

    Without two classes in the folds of the trees every score is the share of toxic texts (0 without labels); without
    two in the fold of the calibration scores are the trees' own.
    """
    texts = labelled(docs, labels, id_col, text_col, label_col)
    counts, sizes = lexicon(texts)
    toxic, total = sum(n for (_, t), n in sizes.items() if t), sum(sizes.values())
    fitted = [{t for (f, t), n in sizes.items() if (f < FOLDS - 1) == part and n} for part in (True, False)]
    if fitted[0] != {0, 1}:
        return Model(Lexicon.of([]), None, None, toxic / total if total else 0.0)
    counts = written(counts, "lexicon")
    all_ = Lexicon.of(_entries(counts, sizes, None))
    rows = feature_rows(texts, [Lexicon.of(_entries(counts, sizes, f)) for f in range(FOLDS)], by_kind=True)
    tasks = max(1, min(texts.sparkSession.sparkContext.defaultParallelism, total // 2000))
    rows = written(rows.repartition(tasks), "features").select(F.shiftright("id", 1).alias("fold"), F.col("id").bitwiseAND(1).cast("double").alias("label"), array_to_vector("features").alias("features"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(rows.where(F.col("fold") < FOLDS - 1))
    calibration = None
    if fitted[1] == {0, 1}:
        # equal probabilities go in as one row with their number
        apart = model.transform(rows.where(F.col("fold") == FOLDS - 1)).groupBy(vector_to_array("probability")[1].alias("p")).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("n"))
        calibration = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="n", predictionCol="share").fit(apart)
    return Model(all_, model, calibration, toxic / total)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every whole text.

    Cases: a null text is the empty text and has a score like any other. Rows without an id are left out; rows that
    repeat an id are scored one by one. Labels of unknown documents and null labels are ignored, several labels of one
    document count by their mean. Without labels every score is 0; an empty table gives no rows. Other columns, the
    language and the source among them, are never looked at.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    rows = feature_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), [model.lexicon])
    scored = model.score(rows)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
