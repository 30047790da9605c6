"""Work that deliveries ask for: kept with the state of each repository in one commit log, tried again, given up in the end.

A stream's batches are received in one commit each; what is due is worked off and acknowledged in a later one, so a
process that dies between the two does the work again.  Nothing is held in the driver but what a commit names.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.sources.commits import CommitLog, Transaction
from quarryloom.sources.staging import staged

#: How often a delivery is tried again after it failed, and how long after.
RETRIES, PAUSE = 3, dt.timedelta(seconds=60)
#: Buckets of a table; a change rewrites those that its rows are in.
BUCKETS = 16
WORK = "delivery_id long, repo_id string, received_at timestamp, payload string, state string, attempts int, error string, due_at timestamp"
PROGRESS = "repo_id string, done long, dead long, last_done_at timestamp, last_delivery_id long"


class WorkLog:
    def __init__(self, spark: SparkSession, root: str, *, retries: int = RETRIES, pause: dt.timedelta = PAUSE):
        self.spark, self.log, self.retries, self.pause = spark, CommitLog(spark, root), retries, pause

    def _change(self, work: Callable[[Transaction], None], **info) -> None:
        def opened(tx: Transaction) -> None:
            tx.table("work", WORK, ["delivery_id"], BUCKETS)
            tx.table("progress", PROGRESS, ["repo_id"], BUCKETS)
            work(tx)

        self.log.transact(opened, **info)

    def work(self) -> DataFrame:
        """delivery_id, repo_id, received_at, payload, state (waiting, done, dead), attempts, error (of the last attempt), due_at."""
        return self.log.read("work", WORK)

    def progress(self) -> DataFrame:
        """repo_id, done, dead, and the delivery that was received last among those done (of several the largest id)."""
        return self.log.read("progress", PROGRESS)

    def dead_letters(self) -> DataFrame:
        return self.work().where("state = 'dead'").drop("state", "due_at")

    def receive(self, batch: DataFrame, now: dt.datetime | None = None) -> None:
        """batch: delivery_id, repo_id, received_at, payload.  Deliveries that are known, or have no id or repository, are left out; of several of one id the smallest payload stays."""
        at = F.lit(now) if now else F.current_timestamp()
        first = F.min(F.struct("received_at", "payload", F.col("repo_id").cast("string").alias("repo_id")))
        rows = staged(batch.where("delivery_id is not null and repo_id is not null").groupBy("delivery_id").agg(first.alias("f")).select("delivery_id", "f.repo_id", "f.received_at", "f.payload"))

        def add(tx: Transaction) -> None:
            fresh = rows.join(tx.read("work", keys=rows).select("delivery_id"), "delivery_id", "left_anti")
            made = fresh.select("*", F.lit("waiting").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"), at.cast("timestamp").alias("due_at"))
            # the buckets are rewritten, not appended to: a batch that is received twice at once meets itself
            tx.change("work", lambda old: old.unionByName(made), touched=rows)

        self._change(add, what="receive")

    def work_off(self, action: Callable[[DataFrame], DataFrame], now: dt.datetime | None = None) -> int:
        """Hands all that is due to the action and acknowledges what came of it; the number of deliveries tried.

        action: takes delivery_id, repo_id, received_at, payload, attempts and gives delivery_id and error (null where it
        went well).  It may be repeated for the same deliveries.  A delivery that it does not return has failed, as have all if it raises.
        """
        now = now or dt.datetime.now()
        due = staged(self.work().where((F.col("state") == "waiting") & (F.col("due_at") <= F.lit(now))).select("delivery_id", "repo_id", "received_at", "payload", "attempts"))
        tried = due.count()
        if not tried:
            return 0
        try:
            judged = self._judged(due, action(due).groupBy("delivery_id").agg(F.max("error").alias("error")))
        except Exception as e:  # noqa: BLE001  # whatever the action raises is an attempt that failed
            judged = self._judged(due, due.select("delivery_id", F.lit(f"{type(e).__name__}: {e}".splitlines()[0][:500]).alias("error")))

        def acknowledge(tx: Transaction) -> None:
            news = judged.select("delivery_id", "was", F.col("state").alias("_s"), F.col("attempts").alias("_a"), F.col("error").alias("_e"))
            # what another worker has acknowledged meanwhile keeps its state
            open_ = lambda old: old.join(news, "delivery_id", "left").withColumn("_mine", F.coalesce((F.col("state") == "waiting") & (F.col("attempts") == F.col("was")), F.lit(False)))
            known = open_(tx.read("work", keys=judged)).where("_mine")
            mine = known.select("repo_id", "received_at", "delivery_id", "_s")

            def stamped(old: DataFrame) -> DataFrame:
                o, m = open_(old), F.col("_mine")
                later = F.lit(now).cast("timestamp") + F.expr(f"INTERVAL '{self.pause.total_seconds()}' SECOND")
                return o.select(
                    "delivery_id", "repo_id", "received_at", "payload", F.when(m, F.col("_s")).otherwise(F.col("state")).alias("state"), F.when(m, F.col("_a")).otherwise(F.col("attempts")).alias("attempts"),
                    F.when(m, F.col("_e")).otherwise(F.col("error")).alias("error"), F.when(m & (F.col("_s") == "waiting"), later).otherwise(F.col("due_at")).alias("due_at"),
                )

            last = F.max(F.when(F.col("_s") == "done", F.struct(F.col("received_at").alias("at"), F.col("delivery_id").alias("id"))))
            delta = mine.groupBy("repo_id").agg(F.count_if(F.col("_s") == "done").alias("done"), F.count_if(F.col("_s") == "dead").alias("dead"), last.alias("l")).select("repo_id", "done", "dead", F.col("l.at").alias("last_done_at"), F.col("l.id").alias("last_delivery_id")).where("done + dead > 0")

            def moved(old: DataFrame) -> DataFrame:
                latest = F.max(F.when(F.col("last_delivery_id").isNotNull(), F.struct(F.col("last_done_at").alias("at"), F.col("last_delivery_id").alias("id"))))
                return old.unionByName(delta).groupBy("repo_id").agg(F.sum("done").alias("done"), F.sum("dead").alias("dead"), latest.alias("l")).select("repo_id", "done", "dead", F.col("l.at").alias("last_done_at"), F.col("l.id").alias("last_delivery_id"))

            tx.change("progress", moved, touched=delta.select("repo_id"))
            tx.change("work", stamped, touched=judged)

        self._change(acknowledge, what="acknowledge")
        return tried

    def _judged(self, due: DataFrame, came: DataFrame) -> DataFrame:
        state = F.when(F.col("error").isNull(), "done").when(F.col("attempts") > self.retries, "dead").otherwise("waiting")
        error = F.when(F.col("_came").isNull(), "no result").otherwise(F.col("error"))
        rows = due.join(came.withColumn("_came", F.lit(True)), "delivery_id", "left")
        return staged(rows.select("delivery_id", "repo_id", "received_at", F.col("attempts").alias("was"), error.alias("error"), (F.col("attempts") + 1).alias("attempts")).withColumn("state", state))

    def batch(self, action: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: receives the batch, then works off what is due; a batch that comes again adds nothing."""

        def run(batch: DataFrame, _id: int) -> None:
            self.receive(batch)
            self.work_off(action)

        return run
