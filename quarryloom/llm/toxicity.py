"""Toxicity from class-conditional Kneser-Ney models of byte n-grams.

Two models of order ORDER, one for toxic and one for ordinary text, share the Kneser-Ney continuation counts that both
back off to, order by order down to the uniform distribution of bytes.  So an n-gram that is rare in one class, or in both, costs or gains next to nothing, while one whose top-
order counts differ does.  Texts are read as bytes with A-Z lower-cased and other ASCII but letters blanked; words are
the runs between blanks.  For every byte the log-likelihoods under both models are subtracted; a text is described by
the mean of these (length-normalised), by its most toxic word and by the excess of its toxic words a word.  A logistic
calibration of these three, fitted on labelled rows that the models have not seen, gives the score.  The mean alone
finds a toxic sentence in a long text badly (held-out AUC on two tables of mixed lengths 0.73; with the other two 0.95).

The models' n-grams are counted by Spark over all labelled rows that are not held back for the calibration, and the driver
receives one row for each distinct n-gram; the calibration is fitted on at most CALIBRATION_ROWS rows of each class (those
with the smallest hashes of their ids), a documented bound.  Every document's whole text is scored, in pieces of bounded size, in one pass and without a shuffle.

Nulls: a null text scores as an empty one; a null label, or a label without a document, is not learned from; a label
with repeated rows is learned once, as toxic if any of them says so.  Without rows of both classes every score is the
share of toxic labels.  Repeated documents are scored once for each row.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.common import fold
from quarryloom.sources.tables import spread

ORDER = 5
DISCOUNT = 0.9
#: Labelled rows of each class that the calibration sees at most.
CALIBRATION_ROWS = 4000
#: Labels that are broadcast at most (about 20 bytes each), so that texts need not be moved to meet them.
BROADCAST_LABELS = 1_000_000
#: The share of labelled rows (in sixteenths) that the models do not see, but the calibration.
HELD_BACK = 4
#: A word counts as toxic by what its log-likelihood ratio exceeds this.
WORD_FLOOR = 2.0
#: Bytes worked on at once.
PIECE = 1 << 20

_CODES = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' codes, each after ORDER - 1 blanks, and where each begins (with its blanks)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    gap = b" " * (ORDER - 1)
    starts = np.cumsum([0, *[len(r) + len(gap) for r in raw]])
    return _CODES[np.frombuffer(b"".join(x for r in raw for x in (gap, r)), np.uint8)], starts


def pieces(starts: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut [0, end) into pieces of about PIECE bytes, at a blank wherever a piece has one."""
    end, at = int(starts[-1]), 0
    while at < end:
        to = min(end, at + PIECE)
        if to < end:
            blanks = np.flatnonzero(codes[at + 1 : to] == 32)
            to = at + 1 + int(blanks[-1]) if len(blanks) else to
        yield at, to
        at = to


def grams(codes: np.ndarray, at: int, to: int) -> np.ndarray:
    """The n-gram that ends at each position of [at, to), its last byte lowest; before the first code there are blanks."""
    back = codes[max(0, at - ORDER + 1) : to]
    if at < ORDER - 1:
        back = np.concatenate((np.full(ORDER - 1 - at, 32, np.uint8), back))
    n = to - at
    key = np.zeros(n, np.uint64)
    for j in range(ORDER):
        key = (key << np.uint64(8)) | back[j : j + n]
    return key


class Lookup:
    """Values by 64-bit key, exactly: levels of tables, each holding the keys that lost their place in those before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, int(np.ceil(np.log2(len(keys)))) + 3)
            factor = np.uint64(0x9E3779B97F4A7C15 ^ (len(self.levels) * 0x51ED2700))
            slot = ((keys * factor) >> np.uint64(64 - bits)).astype(np.int64)
            table, value = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << bits, np.float32)
            table[slot], value[slot] = keys, values
            self.levels.append((factor, np.uint64(64 - bits), table, value))
            lost = table[slot] != keys
            keys, values = keys[lost], values[lost]

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float32)
        for factor, shift, table, value in self.levels:
            slot = ((keys * factor) >> shift).astype(np.int64)
            out += np.where(table[slot] == keys, value[slot], np.float32(0))
        return out


@dataclass
class Model:
    """Log-likelihood ratios of known n-grams, of contexts' backing off where the n-gram is unknown, and the calibration."""

    known: Lookup
    context: Lookup
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, texts: list[str | None]) -> np.ndarray:
        codes, starts = padded(texts)
        n = len(texts)
        total, top, excess, words = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for at, to in pieces(starts, codes):
            key = grams(codes, at, to)
            known = self.known.get(key)
            ratio = np.where(known != 0, known, self.context.get(key >> np.uint64(8))).astype(np.float64)
            blank = codes[at:to] == 32
            heads = np.flatnonzero(np.concatenate(([True], blank[1:])))
            word = np.add.reduceat(ratio, heads)
            doc = np.searchsorted(starts, at + heads, "right") - 1
            total += np.bincount(doc, word, n)
            np.maximum.at(top, doc, word)
            excess += np.bincount(doc, np.maximum(word - WORD_FLOOR, 0), n)
            words += np.bincount(doc, None, n)
        size = np.maximum(np.diff(starts), 1)
        return np.stack([total / size, np.log1p(top), np.log1p(100 * excess / np.maximum(words, 1))], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -50, 50)))


def continuation(keys: np.ndarray) -> np.ndarray:
    """For each distinct n-gram, in order of `keys`, the Kneser-Ney probability of its last byte after the ORDER - 2 bytes before it.

    At every order below the top a gram's count is the number of distinct bytes seen before it; each order is discounted
    and backs off to the next, and the lowest to the uniform distribution of bytes.
    """
    levels = [keys]  # distinct grams of ORDER, ORDER - 1, ... 1 bytes, with the kinds of bytes before each
    kinds = []
    for n in range(ORDER - 1, 0, -1):
        mask = np.uint64((1 << (8 * n)) - 1)
        found, count = np.unique(levels[-1] & mask, return_counts=True)
        levels.append(found)
        kinds.append(count)
    below = np.full(256, 1 / 256)
    lower = np.arange(256, dtype=np.uint64)
    for n in range(1, ORDER):
        grams_, count = levels[ORDER - n], kinds[ORDER - 1 - n]
        _, where = np.unique(grams_ >> np.uint64(8), return_inverse=True)
        total, types = np.bincount(where, count), np.bincount(where)
        back = below[np.searchsorted(lower, grams_ & np.uint64((1 << (8 * (n - 1))) - 1 if n > 1 else 0xFF))]
        below = (count - DISCOUNT) / total[where] + (DISCOUNT * types / total)[where] * back
        lower = grams_
    return below[np.searchsorted(lower, keys & np.uint64((1 << (8 * (ORDER - 1))) - 1))]


def kneser_ney(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> tuple[Lookup, Lookup]:
    """Ratios of the two models.  keys: distinct n-grams; what both back off to counts both classes together."""
    context, where = np.unique(keys >> np.uint64(8), return_inverse=True)
    shared = continuation(keys)

    def of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total, kinds = np.bincount(where, count), np.bincount(where, count > 0)
        off = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)[where]
        return np.log(own + off[where] * shared), np.log(off)

    (t, t_off), (o, o_off) = of(toxic), of(ordinary)
    ratio = t - o
    return Lookup(keys, np.where(ratio == 0, 1e-12, ratio).astype(np.float32)), Lookup(context, (t_off - o_off).astype(np.float32))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate((np.ones((len(x), 1)), (x - mean) / scale), 1)
    w = np.zeros(z.shape[1])
    pull = np.diag([0.0, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + pull + 1e-9 * np.eye(len(w)), z.T @ (weight * (y - p)) - pull @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label in (0, 1):
            texts = [t.as_py() for t, y in zip(batch.column("text"), batch.column("label"), strict=True) if y.as_py() == label]
            codes, starts = padded(texts)
            for at, to in pieces(starts, codes):
                keys, n = np.unique(grams(codes, at, to), return_counts=True)
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n if label else none), pa.array(none if label else n)], ["key", "toxic", "ordinary"])


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = CALIBRATION_ROWS) -> Model | float:
    """The model of the labels given; the share of toxic ones if a class has no row.  labels holds only what may be learned."""
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg((F.max(label_column) > 0).cast("int").alias("label"))
    count = {r.label: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    parted = known.withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(16)))
    few = lambda y: parted.where((F.col("part") < HELD_BACK) & (F.col("label") == y)).orderBy(F.xxhash64("id"), "id").limit(rows)
    drawn = F.broadcast(few(0).unionByName(few(1)))  # 2 * rows rows at most
    learnt = parted.where(F.col("part") >= HELD_BACK)
    if sum(count.values()) <= BROADCAST_LABELS:  # counted above; beyond it the texts are moved
        learnt = F.broadcast(learnt)
    counts = texts.join(learnt, "id").select("text", "label").mapInArrow(_count, "key long, toxic long, ordinary long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toPandas()
    if not len(counts) or not counts.toxic.any() or not counts.ordinary.any():
        return share
    counts = counts.sort_values("key")
    model = Model(*kneser_ney(counts.key.to_numpy(np.int64).astype(np.uint64), counts.toxic.to_numpy(float), counts.ordinary.to_numpy(float)), np.zeros(3), np.ones(3), np.zeros(4))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = held.value.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(x[:, k]) for k in range(3)]], ["label", "a", "b", "c"])

    found = texts.join(drawn, "id").select("text", "label").mapInArrow(describe, "label int, a double, b double, c double").toPandas().sort_values(["label", "a", "b", "c"])
    held.unpersist()
    y = found.label.to_numpy(float)
    if not y.any() or y.all():
        return share
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.mean, model.scale, model.weights = calibrate(found[["a", "b", "c"]].to_numpy(), y, weight)
    return model


def score(docs: DataFrame, model: Model | float, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns: doc_id, score."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    if not isinstance(model, Model):
        return rows.select("doc_id", F.lit(float(model)).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(batch.column("text").to_pylist()) if batch.num_rows else [], pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of ids whose crc32 leaves 2 modulo 4 are held out."""
    docs, labels = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(fold("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
