"""The driver's tables in the roles of the domain, as DataFrames and, for the oracle, as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.sources.tables import spread, table

#: Beginnings of queries; a query's is chosen by its id.
OPENINGS = (
    "Fix the bug in getUserName of src/app/user_service.py where status is not updated:",
    "Where is the class FileUploadController in repo acme/tools, in Python?",
    "Please optimize process_records in lib/data_loader.ts, it should be faster",
    "Add a new feature to handle HTTPServer errors in C++ code:",
    "npm audit says package.json has a vulnerability, fix it",
    "Refactor Parser2 and clean up config.yaml; repository: demo-1.core",
    "show me",
    "",
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: repo_id, file_path, content."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("md", "py", "ts", "bin")]), (F.col("doc_id") % 4 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 13 == 0, F.lit("node_modules")).when(F.col("doc_id") % 17 == 0, F.lit(".cache")).otherwise(F.col("lang"))
    return d.select("doc_id", F.col("source").alias("repo_id"), F.concat_ws("/", "source", folder, F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)).alias("file_path"), F.col("text").alias("content"))


FILES_SQL = """files AS (
  SELECT doc_id, source AS repo_id,
         source || '/' || CASE WHEN doc_id % 13 = 0 THEN 'node_modules' WHEN doc_id % 17 = 0 THEN '.cache' ELSE lang END || '/Doc_' || doc_id || '.' || (['md', 'py', 'ts', 'bin'])[doc_id % 4 + 1] AS file_path,
         text AS content
  FROM documents)"""


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later snapshot: some files gone, some changed, some whose fetch failed."""
    f = files(spark, sf_dir).where("doc_id % 7 != 0")
    return f.select(
        "doc_id", "repo_id", "file_path",
        F.when(F.col("doc_id") % 11 == 0, F.lit("")).when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("\nchanged"))).otherwise(F.col("content")).alias("content"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("failed")).otherwise(F.lit("success")).alias("fetch_status"),
    )


CHANGED_SQL = """changed AS (
  SELECT doc_id, repo_id, file_path, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 5 = 0 THEN content || chr(10) || 'changed' ELSE content END AS content,
         CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS fetch_status
  FROM files WHERE doc_id % 7 <> 0)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as search queries: query_id, query."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.trim(F.concat_ws(" ", opening, "text")).alias("query"))


QUERIES_SQL = f"""queries AS (
  SELECT conv_id * 1000 + turn AS query_id, trim(([{', '.join("'" + o + "'" for o in OPENINGS)}])[(conv_id + turn) % {len(OPENINGS)} + 1] || ' ' || text, ' ') AS query
  FROM conversations WHERE role = 'user')"""


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registered repositories."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS repo_id", "concat('https://github.com/org', c_nationkey, '/Repo-', c_custkey, if(c_custkey % 3 = 0, '.git', '')) AS repo_url", "c_custkey + 100000 AS github_repo_id",
        "if(c_custkey % 5 = 0, 'develop', 'main') AS default_branch", "if(c_acctbal > 0, md5(c_name), if(c_custkey % 2 = 0, '', NULL)) AS last_indexed_commit_sha",
        "if(c_custkey % 4 = 0, c_custkey, NULL) AS github_webhook_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(c_custkey % 977 AS INT)) AS created_at",
    )


REPOS_SQL = """repos AS (
  SELECT c_custkey AS repo_id, 'https://github.com/org' || c_nationkey || '/Repo-' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.git' ELSE '' END AS repo_url, c_custkey + 100000 AS github_repo_id,
         CASE WHEN c_custkey % 5 = 0 THEN 'develop' ELSE 'main' END AS default_branch, CASE WHEN c_acctbal > 0 THEN md5(c_name) WHEN c_custkey % 2 = 0 THEN '' END AS last_indexed_commit_sha,
         CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS github_webhook_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey % 977 AS INT)) AS created_at
  FROM customer)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ingestion jobs."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS job_id", "o_custkey AS repo_id",
        "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS status",
        "o_orderkey % 50 AS files_changed", "o_orderkey % 70 AS files_unchanged", "o_orderkey % 400 AS chunks_upserted", "o_orderdate AS created_at",
        "if(o_orderstatus != 'O', o_orderdate + INTERVAL 1 HOUR, NULL) AS started_at", "if(o_orderstatus = 'F', o_orderdate + INTERVAL 2 HOUR, NULL) AS finished_at",
    )


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS repo_id,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS status,
         o_orderkey % 50 AS files_changed, o_orderkey % 70 AS files_unchanged, o_orderkey % 400 AS chunks_upserted, o_orderdate AS created_at,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 HOUR END AS finished_at
  FROM orders)"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as webhook deliveries; every seventh comes twice."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id AS delivery_id", "ts AS received_at", "CASE WHEN event_type = 'signup' THEN 'ping' WHEN event_type IN ('click', 'purchase') THEN 'push' ELSE event_type END AS event_type",
        "user_id + 100000 AS github_repo_id", "if(event_id % 6 = 0, 'refs/tags/v1', if(event_id % 4 = 0, 'refs/heads/develop', 'refs/heads/main')) AS ref", "props AS payload",
    )
    return e.unionByName(e.where("delivery_id % 7 = 0"))


DELIVERIES_SQL = """once AS (
  SELECT event_id AS delivery_id, ts AS received_at, CASE WHEN event_type = 'signup' THEN 'ping' WHEN event_type IN ('click', 'purchase') THEN 'push' ELSE event_type END AS event_type,
         user_id + 100000 AS github_repo_id, CASE WHEN event_id % 6 = 0 THEN 'refs/tags/v1' WHEN event_id % 4 = 0 THEN 'refs/heads/develop' ELSE 'refs/heads/main' END AS ref, props AS payload
  FROM events),
deliveries AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE delivery_id % 7 = 0)"""
