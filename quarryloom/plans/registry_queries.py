"""Queries over the registry: repositories, jobs, deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.operators import registry as R
from quarryloom.operators import webhooks as W
from quarryloom.plans import fixtures as fx
from quarryloom.sources.tables import table


def prj_owner(spark, sf):
    return R.repo_view(fx.repos(spark, sf)).select("repo_id", "owner", "full_name", "collection", "status", "webhook_configured")


def sql_get_repo_by_id(spark, sf):
    return fx.repos(spark, sf).where("repo_id = 42").select("repo_id", "repo_url", "default_branch")


def sql_get_repo_by_github_id(spark, sf):
    return fx.repos(spark, sf).where("github_repo_id = 100007").select("repo_id", "repo_url", "default_branch")


def sql_get_repo_by_full_name(spark, sf):
    return R.by_full_name(fx.repos(spark, sf), "Repo-33").select("repo_id", "repo_url")


def sql_list_repos(spark, sf):
    return R.page(fx.repos(spark, sf), key="repo_id", limit=100, offset=10).select("repo_id", "created_at")


def sql_active_job(spark, sf):
    return R.with_active_job(fx.repos(spark, sf), fx.jobs(spark, sf)).select("repo_id")


def sql_jobs_page(spark, sf):
    return R.page(fx.jobs(spark, sf).where("repo_id = 7"), key="job_id", limit=50).select("job_id", "status", "created_at")


def sql_job(spark, sf):
    return fx.jobs(spark, sf).where("job_id = 5").select("job_id", "repo_id", "status")


def sql_event_exists(spark, sf):
    return fx.deliveries(spark, sf).where("delivery_id = 14").agg((F.count(F.lit(1)) > 0).alias("found"))


def job_view(spark, sf):
    return R.job_view(fx.jobs(spark, sf))


def sink_job_status(spark, sf):
    j = fx.jobs(spark, sf)
    u = j.where("job_id % 10 < 3").select("job_id", F.element_at(F.array(F.lit("running"), F.lit("completed"), F.lit("failed")), (F.col("job_id") % 10 + 1).cast("int")).alias("new_status"), F.lit("2030-01-01").cast("timestamp").alias("at"))
    return R.set_status(j, u).select("job_id", "status", "started_at", "finished_at")


def job_cancel(spark, sf):
    return R.cancel(fx.jobs(spark, sf), F.col("job_id") % 3 == 0).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def sink_job_progress(spark, sf):
    j = fx.jobs(spark, sf)
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count(F.lit(1)).alias("changed"), F.sum(F.col("l_quantity").cast("long")).alias("upserted")).where("changed > 3")
    return R.set_progress(j, p).select("job_id", "files_changed", "chunks_upserted")


def sink_repo_update(spark, sf):
    latest = fx.jobs(spark, sf).where("status = 'completed'").groupBy("repo_id").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job"))
    return fx.repos(spark, sf).join(latest, "repo_id", "left").select("repo_id", F.coalesce(F.md5(F.col("job").cast("string")), "last_indexed_commit_sha").alias("sha"))


def sink_repo_delete(spark, sf):
    r, j = fx.repos(spark, sf), fx.jobs(spark, sf)
    left = R.delete_repo(r, {"jobs": j}, r.where("repo_id % 9 = 0"))
    return left["repos"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("repos").alias("name"), "n").unionByName(left["jobs"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("jobs").alias("name"), "n"))


def repo_register(spark, sf):
    r = fx.repos(spark, sf)
    wanted = r.select(F.when(F.col("repo_id") % 4 == 0, F.concat("repo_url", F.lit("x"))).when(F.col("repo_id") % 4 == 1, F.lit("https://example.org/a/b")).otherwise(F.col("repo_url")).alias("repo_url")).distinct()
    return R.register(r, wanted).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def sink_event_processed(spark, sf):
    d = W.once(fx.deliveries(spark, sf))
    j = fx.jobs(spark, sf).where("status = 'completed'").select(F.col("job_id").alias("delivery_id"), F.lit(True).alias("done"))
    return d.join(j, "delivery_id", "left").select("delivery_id", F.coalesce("done", F.lit(False)).alias("processed"))


def flt_webhook_push(spark, sf):
    return W.route(fx.deliveries(spark, sf), fx.repos(spark, sf))


def agg_push_files(spark, sf):
    commits = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("added"), F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("modified"), F.array(F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string"))).alias("removed")))).alias("commits")
    )
    f = commits.select("l_orderkey", W.push_files(F.col("commits")).alias("f"))
    return f.select("l_orderkey", *[F.array_join(F.array_sort(f"f.{c}"), ",").alias(c) for c in ("added", "modified", "deleted")])


def join_webhook_tree(spark, sf):
    tree = fx.files(spark, sf).select("file_path", F.when(F.col("doc_id") % 8 == 0, "tree").otherwise("blob").alias("type"))
    diff = fx.files(spark, sf).where("doc_id % 3 != 0").select("file_path", F.element_at(F.array(F.lit("added"), F.lit("modified"), F.lit("removed")), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"))
    return W.changed_entries(tree, diff).select("file_path")


def join_repo_rename(spark, sf):
    """By GitHub id, or by full name where the id is unknown."""
    r = R.repo_view(fx.repos(spark, sf))
    asked = r.select(F.col("repo_id").alias("asked"), F.when(F.col("repo_id") % 2 == 0, F.col("github_repo_id")).alias("gid"), F.when(F.col("repo_id") % 5 != 0, F.col("full_name")).alias("fname"))
    by_id = r.select(F.col("github_repo_id").alias("gid"), F.col("repo_id").alias("a"))
    by_name = r.select(F.col("full_name").alias("fname"), F.col("repo_id").alias("b"))
    return asked.join(by_id, "gid", "left").join(by_name, "fname", "left").select("asked", F.coalesce("a", "b").alias("repo_id"))


def agg_health(spark, sf):
    checks = table(spark, sf, "supplier").select("s_name", F.when(F.col("s_suppkey") % 50 == 0, "disabled").otherwise("ok").alias("state"), "s_nationkey")
    return checks.groupBy("s_nationkey").agg(F.when(F.every(F.col("state") == "ok"), "ok").otherwise("degraded").alias("status"), F.count(F.lit(1)).alias("n"))


def sink_insert(spark, sf):
    """Jobs appended to the table they came from."""
    j = fx.jobs(spark, sf)
    return j.unionByName(j.where("job_id % 100 = 0").withColumn("job_id", F.col("job_id") + 10_000_000)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        prj_owner, sql_get_repo_by_id, sql_get_repo_by_github_id, sql_get_repo_by_full_name, sql_list_repos, sql_active_job, sql_jobs_page, sql_job, sql_event_exists, job_view, sink_job_status,
        job_cancel, sink_job_progress, sink_repo_update, sink_repo_delete, repo_register, sink_event_processed, flt_webhook_push, agg_push_files, join_webhook_tree, join_repo_rename, agg_health, sink_insert,
    )
}

_VIEW = f"""{fx.REPOS_SQL}, viewed AS (SELECT *, string_split(repo_url, '/')[4] AS owner, replace(string_split(repo_url, '/')[5], '.git', '') AS name,
  CASE WHEN coalesce(last_indexed_commit_sha, '') <> '' THEN 'active' ELSE 'pending' END AS status FROM repos)"""
ORACLE_SQL = {
    "prj_owner": f"WITH {_VIEW} SELECT repo_id, owner, owner || '/' || name AS full_name, translate(lower('repo_' || owner || '/' || name), '-./:', '____') AS collection, status, github_webhook_id IS NOT NULL AS webhook_configured FROM viewed",
    "sql_get_repo_by_id": f"WITH {fx.REPOS_SQL} SELECT repo_id, repo_url, default_branch FROM repos WHERE repo_id = 42",
    "sql_get_repo_by_github_id": f"WITH {fx.REPOS_SQL} SELECT repo_id, repo_url, default_branch FROM repos WHERE github_repo_id = 100007",
    "sql_get_repo_by_full_name": f"WITH {fx.REPOS_SQL} SELECT repo_id, repo_url FROM repos WHERE repo_url LIKE '%/Repo-33' OR repo_url LIKE '%/Repo-33.git' ORDER BY created_at, repo_id LIMIT 1",
    "sql_list_repos": f"WITH {fx.REPOS_SQL} SELECT repo_id, created_at FROM repos ORDER BY created_at DESC, repo_id LIMIT 100 OFFSET 10",
    "sql_active_job": f"WITH {fx.REPOS_SQL}, {fx.JOBS_SQL} SELECT repo_id FROM repos WHERE repo_id IN (SELECT repo_id FROM jobs WHERE status IN ('queued', 'running'))",
    "sql_jobs_page": f"WITH {fx.JOBS_SQL} SELECT job_id, status, created_at FROM jobs WHERE repo_id = 7 ORDER BY created_at DESC, job_id LIMIT 50",
    "sql_job": f"WITH {fx.JOBS_SQL} SELECT job_id, repo_id, status FROM jobs WHERE job_id = 5",
    "sql_event_exists": f"WITH {fx.DELIVERIES_SQL} SELECT count(*) > 0 AS found FROM deliveries WHERE delivery_id = 14",
    "job_view": f"WITH {fx.JOBS_SQL} SELECT job_id, repo_id, status, files_changed + files_unchanged AS processed_files, coalesce(finished_at, started_at, created_at) AS updated_at FROM jobs",
    "sink_job_status": f"""WITH {fx.JOBS_SQL} SELECT job_id, CASE job_id % 10 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE status END AS status,
        CASE WHEN job_id % 10 = 0 THEN TIMESTAMP '2030-01-01' ELSE started_at END AS started_at, CASE WHEN job_id % 10 IN (1, 2) THEN TIMESTAMP '2030-01-01' ELSE finished_at END AS finished_at FROM jobs""",
    "job_cancel": f"WITH {fx.JOBS_SQL} SELECT status, count(*) AS n FROM (SELECT CASE WHEN job_id % 3 = 0 AND status IN ('queued', 'running') THEN 'cancelled' ELSE status END AS status FROM jobs) GROUP BY status",
    "sink_job_progress": f"""WITH {fx.JOBS_SQL}, p AS (SELECT l_orderkey AS job_id, count(*) AS changed, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS upserted FROM lineitem GROUP BY 1 HAVING count(*) > 3)
        SELECT job_id, coalesce(changed, files_changed) AS files_changed, coalesce(upserted, chunks_upserted) AS chunks_upserted FROM jobs LEFT JOIN p USING (job_id)""",
    "sink_repo_update": f"""WITH {fx.REPOS_SQL}, {fx.JOBS_SQL}, l AS (SELECT repo_id, job_id AS job FROM jobs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, job_id DESC) = 1)
        SELECT repo_id, coalesce(md5(CAST(job AS VARCHAR)), last_indexed_commit_sha) AS sha FROM repos LEFT JOIN l USING (repo_id)""",
    "sink_repo_delete": f"WITH {fx.REPOS_SQL}, {fx.JOBS_SQL} SELECT 'repos' AS name, count(*) AS n FROM repos WHERE repo_id % 9 <> 0 UNION ALL SELECT 'jobs', count(*) FROM jobs WHERE repo_id NOT IN (SELECT repo_id FROM repos WHERE repo_id % 9 = 0)",
    "repo_register": f"""WITH {fx.REPOS_SQL}, w AS (SELECT DISTINCT CASE repo_id % 4 WHEN 0 THEN repo_url || 'x' WHEN 1 THEN 'https://example.org/a/b' ELSE repo_url END AS repo_url FROM repos)
        SELECT CASE WHEN w.repo_url LIKE 'https://example%' THEN 'invalid' WHEN r.repo_url IS NULL THEN 'created' WHEN coalesce(last_indexed_commit_sha, '') <> '' THEN 'conflict' ELSE 'recreated' END AS outcome, count(*) AS n
        FROM w LEFT JOIN repos r ON r.repo_url = w.repo_url GROUP BY 1""",
    "sink_event_processed": f"WITH {fx.DELIVERIES_SQL}, {fx.JOBS_SQL} SELECT delivery_id, delivery_id IN (SELECT job_id FROM jobs WHERE status = 'completed') AS processed FROM once",
    "flt_webhook_push": f"""WITH {fx.DELIVERIES_SQL}, {fx.REPOS_SQL}, r AS (SELECT o.delivery_id, o.event_type, repo_id,
          CASE WHEN event_type NOT IN ('push', 'ping') THEN 'unsupported event' WHEN event_type = 'push' AND ref NOT LIKE 'refs/heads/%' THEN 'not a branch' WHEN event_type = 'push' AND repo_id IS NULL THEN 'unknown repository'
               WHEN event_type = 'push' AND substr(ref, 12) <> default_branch THEN 'not the default branch' END AS reason FROM once o LEFT JOIN repos USING (github_repo_id))
        SELECT delivery_id, CASE WHEN reason IS NOT NULL THEN 'ignored' WHEN event_type = 'push' THEN 'accepted' ELSE 'ok' END AS outcome, reason, CASE WHEN reason IS NULL AND event_type = 'push' THEN repo_id END AS repo_id FROM r""",
    "agg_push_files": "SELECT l_orderkey, string_agg(DISTINCT 'p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS added, string_agg(DISTINCT 's' || l_suppkey, ',' ORDER BY 's' || l_suppkey) AS modified, string_agg(DISTINCT 'm' || l_suppkey % 3, ',' ORDER BY 'm' || l_suppkey % 3) AS deleted FROM lineitem GROUP BY 1",
    "join_webhook_tree": f"WITH {fx.FILES_SQL} SELECT file_path FROM files WHERE doc_id % 8 <> 0 AND doc_id % 3 = 1",
    "join_repo_rename": "SELECT c_custkey AS asked, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 <> 0 THEN c_custkey END AS repo_id FROM customer",
    "agg_health": "SELECT s_nationkey, CASE WHEN bool_and(s_suppkey % 50 <> 0) THEN 'ok' ELSE 'degraded' END AS status, count(*) AS n FROM supplier GROUP BY 1",
    "sink_insert": f"WITH {fx.JOBS_SQL} SELECT repo_id, count(*) + count(*) FILTER (job_id % 100 = 0) AS n FROM jobs GROUP BY 1",
}
