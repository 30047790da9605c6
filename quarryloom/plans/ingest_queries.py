"""Queries of the ingestion pipeline over two snapshots of the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.functions import hashing as H
from quarryloom.functions.text import language_of
from quarryloom.operators import ingest as I
from quarryloom.operators.chunking import chunk_files
from quarryloom.plans import fixtures as fx
from quarryloom.plans.search_queries import CHUNKS_SQL


def _registry(spark, sf):
    return fx.files(spark, sf).select("repo_id", "file_path", H.sha256(F.col("content")).alias("file_hash"), F.lit("active").alias("status"), language_of(F.col("file_path")).alias("language"))


def _chunk_registry(spark, sf):
    """Chunks of the first snapshot; their points are named anew, but for every fourth file, which has an older id."""
    c = chunk_files(fx.files(spark, sf))
    pid = F.when(F.col("doc_id") % 4 == 0, F.md5(F.concat_ws(":", "file_path", "chunk_hash"))).otherwise(H.point_id(F.col("repo_id"), F.col("file_path"), F.col("chunk_hash")))
    return c.select("repo_id", "file_path", "chunk_hash", "chunk_ord", pid.alias("point_id"), F.col("chunk_ord").alias("row_ord"))


def _touched(spark, sf):
    return I.hash_diff(fx.changed_files(spark, sf), _registry(spark, sf)).where(F.col("change").isin("new", "modified"))


def _new_chunks(spark, sf):
    f = fx.changed_files(spark, sf).join(_touched(spark, sf).select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi")
    return I.reuse_chunks(chunk_files(f.drop("fetch_status")), _chunk_registry(spark, sf))


def join_hash_diff(spark, sf):
    return I.hash_diff(fx.changed_files(spark, sf), _registry(spark, sf)).select("file_path", "file_hash", "change")


def join_chunk_reuse(spark, sf):
    return _new_chunks(spark, sf).select("file_path", "chunk_ord", "point_id", "is_new")


def join_orphan(spark, sf):
    return I.orphans(_chunk_registry(spark, sf), _new_chunks(spark, sf), _touched(spark, sf))


def sink_vector_upsert(spark, sf):
    old = _chunk_registry(spark, sf).groupBy("point_id").agg(F.min("chunk_hash").alias("chunk_hash"))
    new = _new_chunks(spark, sf).select("point_id", F.concat(F.lit("n"), F.col("chunk_hash")).alias("chunk_hash"), "file_path", "chunk_ord")
    return I.upsert(old, new, key="point_id", order=["file_path", "chunk_ord"])


def sink_chunk_registry(spark, sf):
    out = I.replace_chunk_registry(_chunk_registry(spark, sf).drop("row_ord"), _new_chunks(spark, sf), _touched(spark, sf))
    return out.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("point_id").alias("points"), F.countDistinct("file_path").alias("files"))


def sink_file_hash_upsert(spark, sf):
    new = _touched(spark, sf).select("repo_id", "file_path", "file_hash", F.lit("active").alias("status"), F.lit("changed").alias("language"))
    return I.upsert_file_hashes(_registry(spark, sf), new).select("file_path", "file_hash", "status", "language")


def sink_deleted_cleanup(spark, sf):
    gone = I.hash_diff(fx.changed_files(spark, sf), _registry(spark, sf)).where("change = 'deleted'")
    return I.delete(_chunk_registry(spark, sf), gone, ["repo_id", "file_path"]).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


def sink_delete_by_file(spark, sf):
    return I.delete(_chunk_registry(spark, sf), fx.files(spark, sf).where("doc_id % 10 = 1"), ["repo_id", "file_path"]).select("file_path", "chunk_ord")


def sink_delete_by_ids(spark, sf):
    c = _chunk_registry(spark, sf)
    return I.delete(c, c.where("chunk_ord = 0"), ["point_id"]).select("file_path", "chunk_ord")


def sink_delete_by_repo(spark, sf):
    return _chunk_registry(spark, sf).where("repo_id != 'src0'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


def sql_chunks_by_path(spark, sf):
    wanted = F.broadcast(fx.files(spark, sf).where("doc_id in (1, 2, 3)").select("repo_id", "file_path"))
    return _chunk_registry(spark, sf).join(wanted, ["repo_id", "file_path"], "left_semi").select("file_path", "chunk_ord", "chunk_hash")


def sql_active_files(spark, sf):
    return _registry(spark, sf).where("repo_id = 'src1' and status = 'active'").select("file_path", "file_hash")


def src_vector_scroll(spark, sf):
    """The first 500 points of a collection, by id."""
    return _chunk_registry(spark, sf).where("repo_id = 'src0'").select("point_id").distinct().orderBy("point_id").limit(500)


def src_collections(spark, sf):
    from quarryloom.functions.text import collection_name

    return fx.files(spark, sf).select(collection_name(F.concat(F.lit("repo_"), "repo_id")).alias("collection")).distinct()


def prj_enrich(spark, sf):
    new = _new_chunks(spark, sf).where("is_new")
    return I.payload(new, model="hashed-words", dimension=64).select("point_id", "language", "start_line", "end_line", "embedding_model", "embedding_dimension")


def agg_job_rollup(spark, sf):
    return I.job_rollup(fx.changed_files(spark, sf), _new_chunks(spark, sf))


def pipe_ingest(spark, sf):
    plan = I.plan_ingest(fx.changed_files(spark, sf), _registry(spark, sf), _chunk_registry(spark, sf))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    out = plan["changes"].groupBy("change").agg(F.count(F.lit(1)).alias("n")).select(F.col("change").alias("what"), "n")
    return out.unionByName(n(plan["chunks"].where("is_new"), "new chunks")).unionByName(n(plan["chunks"].where("not is_new"), "reused chunks")).unionByName(n(plan["orphans"], "orphans"))


QUERIES = {
    f.__name__: f
    for f in (
        join_hash_diff, join_chunk_reuse, join_orphan, sink_vector_upsert, sink_chunk_registry, sink_file_hash_upsert, sink_deleted_cleanup, sink_delete_by_file, sink_delete_by_ids, sink_delete_by_repo,
        sql_chunks_by_path, sql_active_files, src_vector_scroll, src_collections, prj_enrich, agg_job_rollup, pipe_ingest,
    )
}

_UUID = """substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr({h}, 17, 2))::INT & 63) | 128)) || substr({h}, 19, 2) || '-' || substr({h}, 21, 12)"""
_PID = _UUID.format(h=f"sha1(unhex('{H.NAMESPACE}') || encode(repo_id || ':' || file_path || ':' || chunk_hash))")
_LANG = "CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' END"
_DIFF = f"""{fx.FILES_SQL}, {fx.CHANGED_SQL},
diff AS (SELECT f.doc_id, f.repo_id, f.file_path, CASE WHEN c.fetch_status = 'success' THEN sha256(c.content) END AS file_hash,
  CASE WHEN c.doc_id IS NULL THEN 'deleted' WHEN c.fetch_status = 'failed' THEN 'failed' WHEN sha256(c.content) = sha256(f.content) THEN 'unchanged' ELSE 'modified' END AS change FROM files f LEFT JOIN changed c USING (doc_id))"""


def _chunks(name: str, source: str) -> str:
    """The chunk steps over another table of doc_id, content."""
    sql = CHUNKS_SQL.replace("FROM documents)", f"FROM (SELECT doc_id, content AS text FROM {source}))")
    for word in ("lines", "folded", "whole", "chunked"):
        sql = sql.replace(f"{word} AS (", f"{word}_{name} AS (").replace(f"FROM {word} ", f"FROM {word}_{name} ").replace(f"JOIN {word} ", f"JOIN {word}_{name} ").replace(f"FROM {word}\n", f"FROM {word}_{name}\n").replace(f"FROM {word})", f"FROM {word}_{name})")
    return sql


_BLANK = "length(trim(translate(c.content, chr(10) || chr(9) || chr(13), ''))) > 0"
_REG = f"""{_DIFF}, {_chunks('a', 'files')},
old0 AS (SELECT doc_id, repo_id, file_path, sha256(c.content) AS chunk_hash, ord AS chunk_ord FROM chunked_a JOIN files USING (doc_id) WHERE {_BLANK}),
reg AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN md5(file_path || ':' || chunk_hash) ELSE {_PID} END AS point_id FROM old0)"""
_NEW = f"""{_REG}, touched AS (SELECT c.doc_id, c.content FROM changed c JOIN diff USING (doc_id) WHERE change = 'modified'), {_chunks('b', 'touched')},
new0 AS (SELECT doc_id, repo_id, file_path, sha256(c.content) AS chunk_hash, ord AS chunk_ord, c.s AS start_line, c.e AS end_line FROM chunked_b JOIN files USING (doc_id) WHERE {_BLANK}),
known AS (SELECT file_path, chunk_hash, arg_max(point_id, chunk_ord) AS old_id FROM reg GROUP BY ALL),
new AS (SELECT n.*, old_id IS NULL AS is_new, coalesce(old_id, {_PID}) AS point_id FROM new0 n LEFT JOIN known USING (file_path, chunk_hash))"""
_R = "WITH RECURSIVE "
ORACLE_SQL = {
    "join_hash_diff": f"WITH {_DIFF} SELECT file_path, file_hash, change FROM diff",
    "join_chunk_reuse": f"{_R}{_NEW} SELECT file_path, CAST(chunk_ord AS INT) AS chunk_ord, point_id, is_new FROM new",
    "join_orphan": f"{_R}{_NEW} SELECT DISTINCT point_id FROM reg WHERE doc_id IN (SELECT doc_id FROM touched) AND point_id NOT IN (SELECT point_id FROM new)",
    "sink_vector_upsert": f"""{_R}{_NEW} SELECT point_id, min(chunk_hash) AS chunk_hash FROM reg WHERE point_id NOT IN (SELECT point_id FROM new) GROUP BY 1
        UNION ALL SELECT point_id, 'n' || chunk_hash FROM (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY file_path, chunk_ord) = 1)""",
    "sink_chunk_registry": f"""{_R}{_NEW}, kept AS (SELECT repo_id, file_path, point_id FROM reg WHERE doc_id NOT IN (SELECT doc_id FROM touched) UNION ALL
        SELECT repo_id, file_path, point_id FROM (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY file_path, chunk_hash ORDER BY chunk_ord) = 1))
        SELECT repo_id, count(*) AS n, count(DISTINCT point_id) AS points, count(DISTINCT file_path) AS files FROM kept GROUP BY 1""",
    "sink_file_hash_upsert": f"WITH {_DIFF} SELECT f.file_path, CASE WHEN change = 'modified' THEN file_hash ELSE sha256(f.content) END AS file_hash, 'active' AS status, CASE WHEN change = 'modified' THEN coalesce({_LANG}, 'changed') ELSE {_LANG} END AS language FROM files f JOIN diff USING (doc_id)",
    "sink_deleted_cleanup": f"{_R}{_REG} SELECT repo_id, count(*) AS n FROM reg WHERE doc_id % 7 <> 0 GROUP BY 1",
    "sink_delete_by_file": f"{_R}{_REG} SELECT file_path, CAST(chunk_ord AS INT) AS chunk_ord FROM reg WHERE doc_id % 10 <> 1",
    "sink_delete_by_ids": f"{_R}{_REG} SELECT file_path, CAST(chunk_ord AS INT) AS chunk_ord FROM reg WHERE point_id NOT IN (SELECT point_id FROM reg WHERE chunk_ord = 0)",
    "sink_delete_by_repo": f"{_R}{_REG} SELECT repo_id, count(*) AS n FROM reg WHERE repo_id <> 'src0' GROUP BY 1",
    "sql_chunks_by_path": f"{_R}{_REG} SELECT file_path, CAST(chunk_ord AS INT) AS chunk_ord, chunk_hash FROM reg WHERE doc_id IN (1, 2, 3)",
    "sql_active_files": f"WITH {fx.FILES_SQL} SELECT file_path, sha256(content) AS file_hash FROM files WHERE repo_id = 'src1'",
    "src_vector_scroll": f"{_R}{_REG} SELECT DISTINCT point_id FROM reg WHERE repo_id = 'src0' ORDER BY point_id LIMIT 500",
    "src_collections": "SELECT DISTINCT 'repo_' || source AS collection FROM documents",
    "prj_enrich": f"{_R}{_NEW} SELECT point_id, coalesce({_LANG}, 'unknown') AS language, start_line, end_line, 'hashed-words' AS embedding_model, 64 AS embedding_dimension FROM new WHERE is_new",
    "agg_job_rollup": f"""{_R}{_NEW}, counts AS (SELECT repo_id, count(*) FILTER (fetch_status = 'success') AS n_success, count(*) FILTER (fetch_status = 'failed') AS n_failed FROM changed GROUP BY 1), made AS (SELECT repo_id, count(*) AS n_chunks FROM new GROUP BY 1)
        SELECT repo_id, n_success, n_failed, coalesce(n_chunks, 0) AS n_chunks, CASE WHEN n_failed > 0 AND n_success > 0 THEN 'PARTIAL' WHEN n_failed > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM counts LEFT JOIN made USING (repo_id)""",
    "pipe_ingest": f"""{_R}{_NEW}, ok AS (SELECT doc_id FROM files WHERE doc_id % 4 <> 3 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0), seen AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM ok) THEN change ELSE 'deleted' END AS change FROM diff)
        SELECT change AS what, count(*) AS n FROM seen GROUP BY 1
        UNION ALL SELECT 'new chunks', count(*) FROM new WHERE is_new AND doc_id IN (SELECT doc_id FROM ok) UNION ALL SELECT 'reused chunks', count(*) FROM new WHERE NOT is_new AND doc_id IN (SELECT doc_id FROM ok)
        UNION ALL SELECT 'orphans', count(DISTINCT point_id) FROM reg WHERE doc_id IN (SELECT doc_id FROM touched) AND doc_id IN (SELECT doc_id FROM ok) AND point_id NOT IN (SELECT point_id FROM new WHERE doc_id IN (SELECT doc_id FROM ok))""",
}
