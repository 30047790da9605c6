"""Webhook deliveries as a stream: each once, routed, handed to an action in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "delivery_id long, received_at timestamp, event_type string, github_repo_id long, ref string, payload string"


def read(spark: SparkSession, path: str, *, schema: str = SCHEMA, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def once(stream: DataFrame, *, within: str | None = None) -> DataFrame:
    """Without `within` every id is remembered, exactly; with it ids are forgotten once the watermark has passed."""
    if within is None:
        return stream.dropDuplicates(["delivery_id"])
    return stream.withWatermark("received_at", within).dropDuplicatesWithinWatermark(["delivery_id"])


def routed(stream: DataFrame, repos: DataFrame) -> DataFrame:
    """A stream-static join with the registry."""
    r = repos.select("github_repo_id", F.col("repo_id").alias("known_repo"), "default_branch")
    push = F.col("event_type") == "push"
    good = push & F.col("known_repo").isNotNull() & (F.col("ref") == F.concat(F.lit("refs/heads/"), "default_branch"))
    return stream.join(r, "github_repo_id", "left").select("delivery_id", "received_at", F.when(F.col("event_type") == "ping", "ok").when(good, "accepted").otherwise("ignored").alias("outcome"), F.when(good, F.col("known_repo")).alias("repo_id"))


def run(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the query; `action` must be idempotent by batch id, as a batch is repeated after a failure."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """An action that writes each batch to a folder of its own, over what an earlier attempt left there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def rate(stream: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Deliveries by window and outcome.  (An addition: the system whose data this models has no windows.)"""
    return stream.withWatermark("received_at", late).groupBy(F.window("received_at", window), "outcome").agg(F.count(F.lit(1)).alias("n"))
