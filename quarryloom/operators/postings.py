"""A stored sparse index: postings in buckets of their terms, kept by additions and tombstones.

A chunk that is added appends its postings, stamped with the commit's number; one that is removed leaves a tombstone with a number of its own, which hides older postings
of that chunk.  The number of chunks and the sums of their lengths, from which averages come, are kept as differences.
A search reads the buckets of its terms only.  `compact` rewrites buckets without what is hidden and adds differences up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.operators import search
from quarryloom.sources.commits import CommitLog, Transaction

POSTINGS = "collection string, term string, field string, point_id string, tf long, length int, version long"
TOMBSTONES = "collection string, point_id string, version long"
SIZES = "collection string, n_docs long, function long, class long, code long"
BUCKETS = 64


def open_index(tx: Transaction, *, buckets: int = BUCKETS) -> None:
    tx.table("postings", POSTINGS, ["collection", "term"], buckets)
    tx.table("tombstones", TOMBSTONES, ["collection", "point_id"], buckets)
    tx.table("sizes", SIZES, ["collection"], 1)


def _sizes(chunks: DataFrame, sign: int) -> DataFrame:
    fields = search.field_tokens("function_name", "class_name", "content")
    total = lambda n: (sign * F.sum(F.size(fields[n]).cast("long"))).alias(n)
    return chunks.groupBy("collection").agg((sign * F.count(F.lit(1))).cast("long").alias("n_docs"), *map(total, ("function", "class", "code")))


def add(tx: Transaction, chunks: DataFrame) -> None:
    """chunks: collection, point_id, function_name, class_name, content; none of them in the index."""
    postings, _ = search.term_statistics(chunks, key="point_id", function="function_name", class_="class_name", code="content", on="collection")
    tx.append("postings", postings.withColumn("tf", F.col("tf").cast("long")).withColumn("version", F.lit(tx.base.version + 1).cast("long")))
    tx.append("sizes", _sizes(chunks, 1))


def remove(tx: Transaction, chunks: DataFrame) -> None:
    """The same columns, of chunks in the index."""
    tx.append("tombstones", chunks.select("collection", "point_id", F.lit(tx.base.version + 1).cast("long").alias("version")))
    tx.append("sizes", _sizes(chunks, -1))


def _live(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    dead = tombstones.groupBy("collection", "point_id").agg(F.max("version").alias("until"))
    return postings.join(dead, ["collection", "point_id"], "left").where("until is null or version >= until").drop("until")


def read(log: CommitLog, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: collection, term.  (postings in the asked terms' buckets; sizes by field), as `search.bm25_of` takes them."""
    state = log.state()
    postings = _live(log.read("postings", POSTINGS, keys=asked, state=state), log.read("tombstones", TOMBSTONES, state=state))
    total = log.read("sizes", SIZES, state=state).groupBy("collection").agg(*[F.sum(c).alias(c) for c in ("n_docs", "function", "class", "code")]).where("n_docs > 0")
    average = lambda n: F.greatest(F.col(n) / F.col("n_docs"), F.lit(1.0))
    sizes = total.select("collection", "n_docs", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), average(n).alias("average"), F.lit(w).alias("weight")) for n, w in search.FIELD_WEIGHTS.items()])).alias("s"))
    return postings.drop("version"), sizes.select("collection", "n_docs", "s.*")


def compact(tx: Transaction) -> None:
    """One folder for each bucket, without what tombstones hide."""
    tombstones = tx.read("tombstones")
    tx.change("postings", lambda old: _live(old, tombstones))
    tx.change("tombstones", lambda old: old.where("false"))
    tx.change("sizes", lambda old: old.groupBy("collection").agg(*[F.sum(c).alias(c) for c in ("n_docs", "function", "class", "code")]))


def topk(log: CommitLog, terms: DataFrame, *, k: int = search.LIMIT) -> DataFrame:
    """terms: query_id, collection, term.  Columns: query_id, point_id, score, rank."""
    postings, sizes = read(log, terms.select("collection", "term"))
    return search.bm25_of(postings, sizes, terms, key="point_id", k=k, on="collection")
