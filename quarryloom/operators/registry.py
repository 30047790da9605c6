"""Repositories, jobs and deliveries: look-ups, derived columns, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.functions.text import collection_name, github_parts

ACTIVE = ("queued", "running")
TERMINAL = ("completed", "failed", "partial", "cancelled")


def repo_view(repos: DataFrame) -> DataFrame:
    """Derived columns: owner, name, full_name, collection, status, webhook_configured."""
    p = repos.withColumn("_p", github_parts(F.col("repo_url")))
    full = F.concat_ws("/", "_p.owner", "_p.name")
    return p.select(
        *repos.columns, F.col("_p.owner").alias("owner"), F.col("_p.name").alias("name"), full.alias("full_name"), collection_name(F.concat(F.lit("repo_"), full)).alias("collection"),
        F.when(F.coalesce("last_indexed_commit_sha", F.lit("")) != "", "active").otherwise("pending").alias("status"), F.col("github_webhook_id").isNotNull().alias("webhook_configured"),
    )


def by_full_name(repos: DataFrame, name: str) -> DataFrame:
    """Repositories whose URL ends with /name or /name.git, the oldest first."""
    url = F.col("repo_url")
    return repos.where(url.endswith(f"/{name}") | url.endswith(f"/{name}.git")).orderBy("created_at", "repo_id").limit(1)


def page(df: DataFrame, *, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Newest first; ties by key."""
    return df.orderBy(F.desc("created_at"), key).offset(offset).limit(limit)


def with_active_job(repos: DataFrame, jobs: DataFrame) -> DataFrame:
    return repos.join(jobs.where(F.col("status").isin(*ACTIVE)).select("repo_id"), "repo_id", "left_semi")


def job_view(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "repo_id", "status", (F.col("files_changed") + F.col("files_unchanged")).alias("processed_files"), F.coalesce("finished_at", "started_at", "created_at").alias("updated_at"))


def set_status(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: job_id, new_status, at.  Running sets started_at, terminal states finished_at."""
    new = F.col("new_status")
    j = jobs.join(updates, "job_id", "left")
    return j.select(
        *[c for c in jobs.columns if c not in ("status", "started_at", "finished_at")], F.coalesce(new, F.col("status")).alias("status"),
        F.when(new == "running", F.col("at")).otherwise(F.col("started_at")).alias("started_at"), F.when(new.isin(*TERMINAL), F.col("at")).otherwise(F.col("finished_at")).alias("finished_at"),
    )


def cancel(jobs: DataFrame, wanted: Column) -> DataFrame:
    """Queued and running jobs that are wanted become cancelled."""
    return jobs.withColumn("status", F.when(wanted & F.col("status").isin(*ACTIVE), "cancelled").otherwise(F.col("status")))


def set_progress(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """progress: job_id, changed, upserted."""
    own = [c for c in jobs.columns if c not in ("files_changed", "chunks_upserted")]
    return jobs.join(progress, "job_id", "left").select(*own, F.coalesce("changed", "files_changed").alias("files_changed"), F.coalesce("upserted", "chunks_upserted").alias("chunks_upserted"))


def delete_repo(repos: DataFrame, tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The repository and, by cascade, its rows in every table."""
    ids = gone.select("repo_id").distinct()
    return {"repos": repos.join(ids, "repo_id", "left_anti"), **{n: t.join(ids, "repo_id", "left_anti") for n, t in tables.items()}}


def register(repos: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: repo_url.  conflict if it is known and indexed, recreated if it is known but was never, created otherwise."""
    known = repos.select("repo_url", (F.coalesce("last_indexed_commit_sha", F.lit("")) != "").alias("indexed"))
    valid = github_parts(F.col("repo_url"))["owner"].isNotNull()
    outcome = F.when(~valid, "invalid").when(F.col("indexed").isNull(), "created").when(F.col("indexed"), "conflict").otherwise("recreated")
    return wanted.join(known, "repo_url", "left").select("repo_url", outcome.alias("outcome"))


def health(checks: DataFrame) -> DataFrame:
    """checks: service, state.  ok if all are; a disabled one counts as degraded."""
    return checks.agg(F.when(F.every(F.col("state") == "ok"), "ok").otherwise("degraded").alias("status"), F.count(F.lit(1)).alias("n"))
