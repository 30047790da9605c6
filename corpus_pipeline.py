"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import decontaminate, pieces, quality, secrets, simhash
from quarryloom.llm.common import fold, free_name, fresh_dir
from quarryloom.sources.tables import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half go.  Labels that op3 holds out are not learned here either.

    A null or empty text is scored as an empty one; each of several rows with one id or text is scored by itself, so equal
    texts stay or go together.  Without positive labels all rows stay; an empty table stays empty.
    """
    labels = _table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    docs = spread(docs)
    return quality.keep_good(docs, quality.train(docs, labels))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose sets of five-word shingles have a similarity of 0.8 or more are linked; of each component one row stays.

    It is the row with the smallest id (nulls last), then the smallest MD5 of the text; of rows with both in common any
    one stays.  Null texts count as empty; texts without words are one component.  Rows are told apart by id and text,
    so different texts under one id, or without one, are different documents.  An empty table stays empty.
    """
    key, name = lambda i, m: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), m), free_name(docs, "row_key")
    found = simhash.similar_documents(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("s"))
    stay = first.select(key(F.col("s.doc_id"), F.col("s.mark")).alias(name))
    rows = found.groupBy(key(F.col("doc_id"), F.col("mark")).alias(name)).agg(F.count(F.lit(1)).alias("n")).join(stay.withColumn("stays", F.lit(True)), name, "left")
    where = fresh_dir(spark, "rows")
    rows.where("stays is null or n > 1").write.parquet(where)
    # of what is left out or repeated; broadcast if its file's size is under Spark's threshold, then no other text is moved
    odd = spark.read.schema(f"{name} string, n long, stays boolean").parquet(where)
    marked = docs.withColumn(name, key(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit("")))))
    once = marked.join(odd.where("stays").select(name), name, "left_semi").dropDuplicates([name])
    return marked.join(odd.select(name), name, "left_anti").unionByName(once).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts hold no window and stay; each of several rows with one id or text is judged by its text.  With
    an empty benchmark all rows stay; an empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mask, and n_chars counted anew; all documents stay.

    Null and empty texts stay as they are.  Repeated rows are masked alike; their tokens count each in the thresholds.
    """
    return secrets.redact(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, with their number, their digest, and whether they decode to the text.

    A null or empty text has no pieces; repeated rows are each encoded; an empty table gives no rows.
    """
    return pieces.summarise(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: SQL expresses neither the classifier nor the fingerprints; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        where = fresh_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
