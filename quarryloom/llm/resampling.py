"""Importance resampling towards a target set of texts.

Words are taken by Arrow kernels: ascii_lower, split_pattern_regex, flattened lists and dictionary_encode.  Runs of two and three
words are the dictionary's indices shifted against one another; each distinct run gets its CRC once, from the CRC of
what comes before and that of the last word (a linear map for each length), and from it a bucket.  A first pass adds up the
buckets of the corpus and of the target; a second one takes each bucket's gain and adds up the gains of each document's runs.
Documents are drawn by weight and Gumbel noise from a hash of the id: scores are ordered by ranges, and a rank is a row's place
in its range plus the sizes of the ranges before it, so no task sees more than its range.

Odd rows: a null or empty text has no words, weight 0, and is never drawn; repeated rows count each and are ranked each;
a null id hashes as an empty one and comes last among ties.  An empty target or table is all zeros.  Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.common import filed
from quarryloom.sources.tables import spread

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, RUNS, SEED = 10_000, 3, 42
#: Of the documents with at least so many words, so many of a hundred are drawn.
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of text that are split together; a longer text is taken by itself.
BYTES = 4 << 20


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """Four tables that map a CRC to what it becomes after so many bytes, but for what those bytes add."""
    zeros = bytes(length)
    none = zlib.crc32(zeros, 0)
    bits = np.array([zlib.crc32(zeros, 1 << k) ^ none for k in range(32)], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k // 8][(np.arange(256) >> (k % 8)) & 1 == 1] ^= bits[k]
    return out


def appended(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts of which the first part has CRC `before` and the rest has CRC `after` and so many bytes."""
    out = after.copy()
    order = np.argsort(length, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(length[order])) + 1, len(order))
    for at, to in zip(np.append(0, ends[:-1]), ends, strict=True):
        here = order[at:to]
        if len(here):
            t, c = _shift(int(length[here[0]])), before[here]
            out[here] ^= t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
    return out


def runs(texts: pa.Array, buckets: int = BUCKETS, longest: int = RUNS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of run: (first word's place, index of the run, bucket of each distinct run); before them, once, the texts' first places."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "")
    coded, parent = flat.filter(full).dictionary_encode(), parent[full.to_numpy(zero_copy_only=False)]
    starts = np.searchsorted(parent, np.arange(len(texts) + 1))
    yield starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    space = zlib.crc32(b" ")
    after = np.array([zlib.crc32(w, space) for w in words], np.uint32)
    length = np.array([len(w) + 1 for w in words], np.int64)
    crc, run, place = np.array([zlib.crc32(w) for w in words], np.uint32), word, np.arange(len(word))
    for n in range(1, longest + 1):
        if n > 1:
            # the run before without its last place, and the word that follows it in the same text
            inside = parent[place] == parent[np.minimum(place + n - 1, len(word) - 1)] if len(word) else np.zeros(0, bool)
            inside &= place + n - 1 < len(word)
            run, place = run[inside], place[inside]
            pairs = pa.array(run * max(1, len(words)) + word[place + n - 1]).dictionary_encode()
            distinct = pairs.dictionary.to_numpy()
            run = pairs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            last = distinct % max(1, len(words))
            crc = appended(crc[distinct // max(1, len(words))], after[last], length[last])
        yield place, run, (crc % np.uint32(buckets)).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(BUCKETS, np.int64)
    for piece in _pieces(batches):
        first = True
        for _, run, bucket in runs(piece.column("text")):
            if not first:
                np.add.at(found, bucket, np.bincount(run, minlength=len(bucket)))
            first = False
    full = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(found[full])], ["bucket", "n"])


def _weighed(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            found = runs(piece.column("text"))
            starts = next(found)[0]
            features, weight = (np.zeros(len(starts) - 1, np.int64) for _ in range(2))
            for place, index, bucket in found:
                bounds = np.searchsorted(place, starts)
                total = np.append(0, np.cumsum(gains[bucket][index]))
                features += np.diff(bounds)
                weight += total[bounds[1:]] - total[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(starts)), pa.array(features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket; at most BUCKETS rows reach the driver."""
    rows = texts.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, one added to each bucket."""
    every, wanted = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (every + BUCKETS) / ((s + 1.0) * (wanted + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Columns: doc_id, n_words, n_features, weight, score."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return found.withColumn("score", (F.col("weight") + noise).cast("long"))


def draw(scored: DataFrame, *, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored, with rank: 1 for the highest score of those drawn, null where not drawn."""
    rows = filed(scored.withColumn("row", F.monotonically_increasing_id()))
    can = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    # the id of a row in a sorted partition holds its range and its place there
    ordered = filed(rows.where(can).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    span, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r.span: r.n for r in ordered.groupBy(span.alias("span")).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted, before, passed = percent * sum(sizes.values()) // 100, [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(passed)
        passed += sizes.get(k, 0)
    offset = F.element_at(F.array(*map(F.lit, before)).cast("array<long>"), (span + 1).cast("int")) if before else F.lit(0)
    rank = (offset + place + 1).cast("long")
    return ordered.withColumn("rank", F.when(rank <= wanted, rank)).drop("row", "at").unionByName(rows.where(~can).withColumn("rank", F.lit(None).cast("long")).drop("row"))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents, towards the texts of the benchmark."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gain = gains(bucket_counts(docs), bucket_counts(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return draw(weigh(docs, gain)).select("doc_id", "n_features", "weight", "score", "rank")
