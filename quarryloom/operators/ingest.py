"""Ingestion over snapshots: what changed, which chunks are reused, what is written and what is deleted.

Tables are snapshots.  A mutation is a new snapshot: rows that stay (an anti-join) and rows that come (a union).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.functions import hashing as H


def hash_diff(files: DataFrame, registry: DataFrame, *, partial: bool = False, delete_failed: bool = False) -> DataFrame:
    """files: repo_id, file_path, content, fetch_status; registry: repo_id, file_path, file_hash (active rows).

    Columns: repo_id, file_path, file_hash, change (new, modified, unchanged, failed, deleted).  A partial listing
    deletes nothing.  A file whose fetch failed keeps its index unless delete_failed asks for the older behaviour.
    """
    f = files.select("repo_id", "file_path", "fetch_status", H.sha256(F.col("content")).alias("new_hash"))
    r = registry.select("repo_id", "file_path", F.col("file_hash").alias("old_hash"))
    failed = F.col("fetch_status") == "failed"
    change = (
        F.when(F.col("fetch_status").isNull(), F.lit(None if partial else "deleted"))
        .when(failed, F.lit("failed"))
        .when(F.col("old_hash").isNull(), F.lit("new"))
        .when(F.col("old_hash") == F.col("new_hash"), F.lit("unchanged"))
        .otherwise(F.lit("modified"))
    )
    out = f.join(r, ["repo_id", "file_path"], "full_outer").select("repo_id", "file_path", F.when(~failed, F.col("new_hash")).alias("file_hash"), change.alias("change"), "old_hash")
    if delete_failed:
        out = out.withColumn("change", F.when((F.col("change") == "failed") & F.col("old_hash").isNotNull(), F.lit("deleted")).otherwise(F.col("change")))
    return out.where("change is not null").drop("old_hash")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def reuse_chunks(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Each chunk with its point: the registry's last one for (repo, path, hash), or a new name-based id; is_new tells which."""
    known = registry.groupBy("repo_id", "file_path", "chunk_hash").agg(F.max_by("point_id", "row_ord").alias("old_id"))
    out = chunks.join(known, ["repo_id", "file_path", "chunk_hash"], "left")
    made = H.point_id(F.col("repo_id"), F.col("file_path"), F.col("chunk_hash"))
    return out.withColumn("is_new", F.col("old_id").isNull()).withColumn("point_id", F.coalesce("old_id", made)).drop("old_id")


def upsert(old: DataFrame, new: DataFrame, *, key: str, order: list) -> DataFrame:
    """New rows (the first of each key) replace old ones."""
    fresh = first_per(new, [key], order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(old.columns))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def orphans(old: DataFrame, new: DataFrame, modified: DataFrame) -> DataFrame:
    """Points of modified files that no new chunk has."""
    return old.join(modified.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi").select("point_id").distinct().join(new.select("point_id").distinct(), "point_id", "left_anti")


def replace_chunk_registry(old: DataFrame, new: DataFrame, modified: DataFrame, *, across_files: bool = False) -> DataFrame:
    """Rows of modified files go; new rows come, one for each hash of a file (of the whole repository if across_files)."""
    keys = ["repo_id", "chunk_hash"] if across_files else ["repo_id", "file_path", "chunk_hash"]
    kept = delete(old, modified, ["repo_id", "file_path"])
    return kept.unionByName(first_per(new, keys, ["file_path", "chunk_ord"]).select(old.columns))


def upsert_file_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hash and status of known files are replaced (language stays); unknown ones are added."""
    n = new.select("repo_id", "file_path", F.col("file_hash").alias("n_hash"), F.col("status").alias("n_status"), F.col("language").alias("n_language"))
    return old.join(n, ["repo_id", "file_path"], "full_outer").select(
        "repo_id", "file_path", F.coalesce("n_hash", "file_hash").alias("file_hash"), F.coalesce("n_status", "status").alias("status"), F.coalesce("language", "n_language").alias("language")
    )


def rollup_status(failed: Column, fetched: Column) -> Column:
    return F.when((failed > 0) & (fetched > 0), "PARTIAL").when(failed > 0, "FAILED").otherwise("COMPLETED")


def job_rollup(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per repository: successes, failures, chunks and the job's final status."""
    counts = files.groupBy("repo_id").agg(F.count_if(F.col("fetch_status") == "success").alias("n_success"), F.count_if(F.col("fetch_status") == "failed").alias("n_failed"))
    made = chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return counts.join(made, "repo_id", "left").select("repo_id", "n_success", "n_failed", F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), rollup_status(F.col("n_failed"), F.col("n_success")).alias("status"))


def payload(chunks: DataFrame, *, model: str, dimension: int) -> DataFrame:
    """The fields that are stored with a new chunk's vector."""
    from quarryloom.functions.text import language_of

    return chunks.select(
        "point_id", "repo_id", "file_path", "chunk_hash", "chunk_ord", "start_line", "end_line", F.coalesce(language_of(F.col("file_path")), F.lit("unknown")).alias("language"), "content",
        F.lit(model).alias("embedding_model"), F.lit(dimension).alias("embedding_dimension"),
    )


def plan_ingest(files: DataFrame, registry: DataFrame, chunk_registry: DataFrame) -> dict[str, DataFrame]:
    """The whole run from a listing: changes, the chunks of new and modified files with their points, orphans, files to clean up."""
    from quarryloom.functions.text import is_source_file
    from quarryloom.operators.chunking import chunk_files

    kept = files.where(is_source_file(F.col("file_path")))
    changes = hash_diff(kept, registry)
    touched = changes.where(F.col("change").isin("new", "modified"))
    chunks = reuse_chunks(chunk_files(kept.join(touched.select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi")), chunk_registry)
    return {
        "changes": changes,
        "chunks": chunks,
        "orphans": orphans(chunk_registry, chunks, touched),
        "deleted": changes.where("change = 'deleted'").select("repo_id", "file_path"),
    }
