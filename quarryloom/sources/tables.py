"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core below which a table of few files is dealt out before much work is done on its rows.
SMALL = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Only Spark's reader touches the path, so it may be in any store that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, if they are few and lie in fewer files than there are cores; else as they are.

    A file of one row group is read by one task, however many cores there are.  Tables of any size worth a cluster are in
    many files or row groups and are never moved by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL * cores:
        return df
    return df.repartition(cores)
