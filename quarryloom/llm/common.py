"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset (tests), a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quarryloom-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A name in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: a join broadcasts them if their files' size is under Spark's threshold."""
    where = fresh_dir(df.sparkSession, "filed")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def fold(id_column: str, mod: int) -> F.Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % F.lit(mod)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or, if a column has it in any case, the name with underscores ahead until none has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, *, share: int = 256, parts: int = 64) -> DataFrame:
    """Inner join of rows with facts, which have one row for each key and, in `count`, how many rows it has.

    Keys with more than one row in `share` (so fewer than `share` keys, which are broadcast) are dealt to `parts` tasks.
    facts should be cheap to evaluate twice.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(facts.where(F.col(count) > F.lit(total / share)).select(key, F.lit(True).alias("_hot")))
    left = rows.join(hot, key, "left").withColumn("_part", F.when(F.col("_hot"), (F.monotonically_increasing_id() % parts).cast("int")).otherwise(0)).drop("_hot")
    right = facts.join(hot, key, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot", count)
    return left.join(right, [key, "_part"]).drop("_part")
