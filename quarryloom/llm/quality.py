"""Quality by positive-unlabelled learning.

A linear model on measures of a text's style minimises the non-negative unbiased risk
    prior * R(positive, +1) + max(0, R(unlabelled, -1) - prior * R(positive, -1))
with logistic loss, over all trusted positives and all unlabelled text.  Labels of value 0 are never used.

Every text is measured once, whole, and its measures (20 numbers) are written as a table; nothing is sampled.  Spark
then adds up, over that table: the moments of both sets, from which a first discriminant comes that tells positives
from unlabelled text; the tails of both sets along it, which give the prior (the least ratio of unlabelled to positive
mass in an upper tail, for a tail without negatives has that ratio, with both shares widened by their standard
errors); and, for each Newton step on the risk, its value, gradient and curvature.  The driver receives sums only.
Logistic loss is linear-odd, so the unbiased risk is convex; where its second part would be negative, a step goes back up
along that part's gradient.

Nulls: a null text scores as an empty one; null labels or labels without a document are not learned from; a repeated
label counts once, as positive only if all its rows are; each row of a repeated document is learned from.  Without
positives every score is 1.  Repeated documents are scored once for each row.  Other columns are ignored by `score`
and kept by `keep_good`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.llm.common import fold, free_name, fresh_dir
from quarryloom.sources.tables import spread

#: Bytes of a text after which it is cut at the next blank; what is counted does not depend on it.
PIECE = 1 << 20
#: Newton steps at most, and the change of a weight under which they end.
STEPS, ENOUGH = 25, 1e-4
RIDGE = 1e-4
#: Tails of the positives, from which the prior is read.
TAILS = np.linspace(0.02, 0.7, 60)
#: Bins of the discriminant's values.
BINS = 4096

_KIND = np.zeros(256, np.int64)  # 0: other punctuation and control characters
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), b" \t", b"\n\r", b".,;:?'\"-()", b"!", b"%#$&*@~^+=<>\\_`{}[]", b"|/"), 1):
    for _b in _set:
        _KIND[_b] = _k
KINDS = 11
COUNTS = KINDS + 9
MEASURES = 18


_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def counts(text: str | None, piece: int = PIECE) -> np.ndarray:
    """Bytes by kind, then words, their bytes, distinct words, repeats of the word before, distinct pairs, short words, words that end in an odd byte, lines, distinct lines."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(COUNTS)
    types: dict[bytes, int] = {}
    pairs = [np.zeros(0, np.int64)]
    at, last = 0, np.zeros(0, np.int64)
    while at < len(raw):
        found = _BLANK.search(raw, at + piece) if at + piece < len(raw) else None
        to = found.start() if found else len(raw)
        part = raw[at:to]
        at = to
        out[:KINDS] += np.bincount(_KIND[np.frombuffer(part, np.uint8)], minlength=KINDS)
        words = part.split()
        led = np.concatenate((last, np.array([types.setdefault(w, len(types)) for w in words], np.int64)))  # with the word before
        same = (led[1:] == led[:-1]).sum()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        pairs.append(np.unique(led[:-1] << 32 | led[1:]))
        out[[KINDS, KINDS + 1, KINDS + 3, KINDS + 5, KINDS + 6]] += [len(words), lengths.sum(), same, (lengths <= 3).sum(), sum(w[-1] in _ODD for w in words)]
        last = led[-1:]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[[KINDS + 2, KINDS + 4, KINDS + 7, KINDS + 8]] = [len(types), len(np.unique(np.concatenate(pairs))), len(lines), len(set(lines))]
    return out


_ODD = frozenset(b for b in range(128) if not (chr(b).isalnum() or chr(b) in ".,;:?'\"-()"))


def measures(texts: list[str | None]) -> np.ndarray:
    c = np.stack([counts(t) for t in texts]) if texts else np.zeros((0, COUNTS))
    kinds, (words, size, types, same, pairs, short, odd, lines, kept) = c[:, :KINDS], c[:, KINDS:].T
    bytes_ = np.maximum(kinds.sum(1), 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 4], 1)
    n = np.maximum(words, 1)
    shares = [kinds[:, 2] / letters, kinds[:, 3] / bytes_, kinds[:, 0] / bytes_, kinds[:, 6] / bytes_, kinds[:, 7] / bytes_, kinds[:, 8] / bytes_, kinds[:, 9] / bytes_, kinds[:, 10] / bytes_, same / n, 1 - pairs / np.maximum(words - 1, 1), short / n, odd / n, 1 - kept / np.maximum(lines, 1), kinds[:, 5] / bytes_]
    rest = [np.log1p(size / n), np.log1p(words), np.log(np.maximum(types, 1)) / np.log(n + 1), (words == 0).astype(float)]
    return np.stack([*[np.sqrt(np.clip(s, 0, 1)) for s in shares], *rest], 1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(self.weights[0] + z @ self.weights[1:])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -60, 60)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from both sets' counts by bins of scores that tell them apart, lowest bin first."""
    upper = lambda n: np.cumsum(n[::-1])[::-1]
    n, m = positive.sum(), unlabelled.sum()
    at = np.unique(np.searchsorted(np.cumsum(positive), TAILS * n))
    p, u = upper(positive)[at] / n, upper(unlabelled)[at] / m
    error = np.sqrt(u * (1 - u) / m) + np.sqrt(p * (1 - p) / n)
    return float(np.clip(((u + error) / p).min(), 0.02, 0.98))


def _added(held: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums of of(measures, whether positive) over all rows: a vector for each partition, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, MEASURES)
                total += of(x, batch.column("positive").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["k", "v"])

    # the sum of each partition is shuffled by its place; the driver gets `size` numbers
    out = np.zeros(size)
    for r in held.mapInArrow(run, "k int, v double").groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("v")).collect():
        out[r.k] = np.sum(r.v)  # in one order, so that a rerun gives the same sum
    return out


def non_negative_risk(terms: Callable[[np.ndarray], tuple], prior: float, start: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights (the first is the intercept) that minimise the non-negative risk.

    terms(w): over the positives, mean margin, loss as negatives, and their gradients; over the unlabelled, mean loss as
    negatives, its gradient and curvature.
    """
    w, scale, best = start, 1.0, None
    ridge = np.diag([0.0, *[RIDGE] * (len(w) - 1)])
    for _ in range(steps):
        margin, as_negative, margin_up, negative_up, loss, up, curve = terms(w)
        inner = loss - prior * as_negative
        if inner < 0:  # back up, along the second part alone
            w = w + 0.1 * (up - prior * negative_up)
            continue
        risk = loss - prior * margin + 0.5 * w @ ridge @ w
        if best is not None and risk > best[0] + 1e-12:  # too far: halfway back
            w = (w + best[1]) / 2
            scale /= 2
            if scale < 1e-3:
                break
            continue
        best, scale = (risk, w), 1.0
        step = np.linalg.solve(curve + ridge + 1e-9 * np.eye(len(w)), up - prior * margin_up + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < ENOUGH:
            break
    return best[1] if best is not None else w


def fit(held: DataFrame) -> Model | None:
    """held: x (measures), positive.  None without positives."""
    n = MEASURES

    def moments(x, y):
        p = x[y]
        return np.concatenate(([len(p)], p.sum(0), (p.T @ p).ravel(), [len(x)], x.sum(0), (x.T @ x).ravel()))

    one = 1 + n + n * n
    sums = _added(held, moments, 2 * one)
    (np_, sp, qp), (nu, su, qu) = ((s[0], s[1 : n + 1], s[n + 1 :].reshape(n, n)) for s in (sums[:one], sums[one:]))
    if not np_:
        return None
    mean, scale = su / nu, np.maximum(np.sqrt(np.maximum(np.diag(qu) / nu - (su / nu) ** 2, 0)), 1e-3)
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    within = (qp / np_ - np.outer(sp, sp) / np_**2 + qu / nu - np.outer(su, su) / nu**2) / np.outer(scale, scale)
    apart = np.linalg.solve(within + 1e-2 * np.eye(n), (sp / np_ - mean) / scale)
    reach = 8 * np.abs(apart).sum() + 1e-9

    def tails(x, y):
        at = np.clip(((z(x) @ apart) / reach + 1) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate((np.bincount(at[y], minlength=BINS), np.bincount(at, minlength=BINS)))

    tail = _added(held, tails, 2 * BINS)
    prior = estimate_prior(tail[:BINS], tail[BINS:])

    def terms(w):
        def at(x, y):
            d = np.concatenate((np.ones((len(x), 1)), z(x)), 1)
            g = d @ w
            s, loss = _sigmoid(g), np.logaddexp(0, g)
            p = d[y]
            return np.concatenate(([g[y].sum(), loss[y].sum()], p.sum(0), s[y] @ p, [loss.sum()], s @ d, ((d * (s * (1 - s))[:, None]).T @ d).ravel()))

        m = n + 1
        v = _added(held, at, 3 + 3 * m + m * m)
        v[: 2 + 2 * m] /= np_
        v[2 + 2 * m :] /= nu
        return v[0], v[1], v[2 : 2 + m], v[2 + m : 2 + 2 * m], v[2 + 2 * m], v[3 + 2 * m : 3 + 3 * m], v[3 + 3 * m :].reshape(m, m)

    weights = non_negative_risk(terms, prior, np.concatenate(([0.0], np.zeros(n))))
    return Model(mean, scale, weights, prior)


def _measurer(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measures(batch.column("text").to_pylist()).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * MEASURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], [*names, "x"])

    return run


def measured(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """Columns: doc_id, x, positive; written in the shared folder.  labels holds only what may be learned."""
    spark = docs.sparkSession
    trusted = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(F.coalesce(F.col(label_column), F.lit(0))).alias("y")).where("y = 1").select("id", F.lit(0).alias("pad"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(_measurer(["doc_id"]), "doc_id long, x array<float>")
    # rows without an id meet no label, and are dealt by their measures so that they do not meet one another
    keyed = rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "pad": F.when(F.col("doc_id").isNull(), F.shiftright(F.hash("x"), 1).bitwiseOR(F.lit(1))).otherwise(0)})
    where = fresh_dir(spark, "measures")
    keyed.join(trusted.withColumn("positive", F.lit(True)), ["id", "pad"], "left").select("doc_id", "x", F.coalesce("positive", F.lit(False)).alias("positive")).write.parquet(where)
    return spark.read.parquet(where)


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model | None:
    """None without positives.  labels holds only what may be learned."""
    return fit(measured(docs, labels, id_column=id_column, text_column=text_column, label_column=label_column))


def _scorer(held, x_of: Callable[[pa.RecordBatch], np.ndarray], names: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.score(x_of(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(s, pa.float64())], [*names, name])

    return run


def _of_text(text: str):
    # as floats of the same width as in the table of measures, so that both ways give the same scores
    return lambda batch: measures(batch.column(text).to_pylist()).astype(np.float32).astype(np.float64)


def score_measured(held: DataFrame, model: Model | None) -> DataFrame:
    """Columns: doc_id, score, of rows that are measured already."""
    if model is None:
        return held.select("doc_id", F.lit(1.0).alias("score"))
    x_of = lambda batch: batch.column("x").flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, MEASURES)
    return held.select("doc_id", "x").mapInArrow(_scorer(held.sparkSession.sparkContext.broadcast(model), x_of, ["doc_id"], "score"), "doc_id long, score double")


def score(docs: DataFrame, model: Model | None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns: doc_id, score."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(1.0).alias("score"))
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), _of_text("text"), ["doc_id"], "score"), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | None, *, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, as they are, whose texts score at least `threshold`."""
    if model is None:
        return docs
    name = free_name(docs, "quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    scored = docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), _of_text(text_column), docs.columns, name), schema)
    return scored.where(F.col(name) >= threshold).drop(name)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of ids whose crc32 leaves 1 modulo 3 are held out."""
    docs, labels = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = measured(docs, labels.where(fold("doc_id", 3) != 1))
    return score_measured(held, fit(held)).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
