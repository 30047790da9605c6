"""Queries over the remaining small operators, and the search stages as a whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryloom.api import run_search
from quarryloom.functions import text as X
from quarryloom.operators import audit as A
from quarryloom.operators import search as S
from quarryloom.operators.embedding import embed
from quarryloom.plans import fixtures as fx
from quarryloom.plans.review_queries import _ADV, _audits, _direct
from quarryloom.plans.search_queries import _corpus
from quarryloom.plans.text_queries import _SIMPLE
from quarryloom.sources import files as src
from quarryloom.sources.staging import stored
from quarryloom.sources.tables import table
from quarryloom.streaming.deliveries import rate


def src_git_tree(spark, sf):
    listing = fx.files(spark, sf).select(F.col("file_path").alias("path"), F.when(F.col("doc_id") % 6 == 0, "tree").otherwise("blob").alias("type"), F.sha1("content").alias("sha"), F.when(F.col("doc_id") % 4 != 0, F.length("content")).alias("size"))
    return src.git_tree(listing)


def flt_zip_path(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("a/b.py", "../x", "/abs", "a/../b", "c:\\x", "ok..py", "d/..e/f")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf, "part").where(src.is_safe_path(name)).select("p_partkey")


def flt_binary(spark, sf):
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.encode("text", "UTF-8"), F.lit(b"\0x"))).when(F.col("doc_id") % 3 == 1, F.lit(b"a\x10\x01\0")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", X.is_binary(content).alias("is_binary"))


def prj_decode(spark, sf):
    content = F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff\xc3"), F.lit(b"end"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.decoded(content)).alias("digest"))


def flt_branch_name(spark, sf):
    return fx.deliveries(spark, sf).where(X.is_branch_name(F.col("ref")) & (F.col("delivery_id") % 7 != 0)).select("delivery_id")


def flt_sanitize_query(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(X.sanitised_query(F.concat(F.lit("  "), "text"))).alias("n"))


def flt_package_files(spark, sf):
    names = F.element_at(F.array(*[F.lit(x) for x in ("package.json", "web/Package.JSON", "my-package.json", "package-lock.json", "x.json")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").where(F.lower(names).endswith("package.json") | F.lower(names).endswith("package-lock.json")).select("p_partkey")


def src_manifest_scroll(spark, sf):
    """The first 500 points of each collection, of these the manifests, one for each hash, package files first."""
    c = _corpus(spark, sf).withColumn("file_path", F.when(F.pmod(F.length("content"), F.lit(7)) == 0, F.concat("file_path", F.lit("/package.json"))).otherwise(F.col("file_path")))
    first = c.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("chunk_key"))).where("n <= 500 and file_path like '%package.json'")
    return first.withColumn("r", F.row_number().over(Window.partitionBy("repo_id", "chunk_hash").orderBy("chunk_key"))).where("r = 1").select("repo_id", "chunk_key")


def prj_paths_match(spark, sf):
    f = fx.files(spark, sf)
    other = F.when(F.col("doc_id") % 3 == 0, F.element_at(F.split("file_path", "/"), -1)).when(F.col("doc_id") % 3 == 1, F.upper("file_path")).otherwise(F.concat(F.lit("zz/"), F.element_at(F.split("file_path", "/"), -1)))
    return f.select("doc_id", X.paths_match(F.col("file_path"), other).alias("same"))


def fn_aliases(spark, sf):
    f = fx.files(spark, sf).select("doc_id", "file_path", F.regexp_extract("content", "([A-Za-z]{3,})", 1).alias("symbol"))
    stem = F.lower(F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]+$", ""))
    names = F.filter(F.array(F.lower("symbol"), F.when(F.length(stem) > 4, stem)), lambda a: F.length(a) > 3)
    return f.select("doc_id", F.array_join(F.array_sort(F.array_distinct(names)), "|").alias("aliases"))


def agg_dedupe_max(spark, sf):
    """Hits of equal text are one: the first in order stays, with the best score."""
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("key"), F.md5("text").alias("h"), (F.col("n_chars") % 97 / 97).alias("rrf"), F.col("doc_id").alias("rank"))
    return S.dedupe(d, by="h", key="key").select("query_id", "key", F.round("rrf", 9).alias("rrf"))


def agg_first_fix(spark, sf):
    return A.by_package(A.advisories(_audits(spark, sf), _direct(spark, sf))).where("patched_version is not null").select("audit_id", "package", "patched_version")


def set_intersect_terms(spark, sf):
    signals = F.array(*[F.lit(x) for x in ("the", "de", "licensed", "password")])
    return table(spark, sf, "documents").select("doc_id", (F.size(F.array_intersect(signals, X.simple_tokens(F.col("text")))) / F.size(signals)).alias("share"))


def win_zip_limits(spark, sf):
    """Running counts and bytes of the files of each source, until a limit is passed."""
    w = Window.partitionBy("repo_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    f = fx.files(spark, sf).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("bytes", F.sum(F.octet_length("content")).over(w))
    return f.where("n <= 30 and bytes <= 60000").select("repo_id", "doc_id", "n", "bytes")


def understand(spark, sf):
    u = S.understand(fx.queries(spark, sf))
    return u.groupBy(F.coalesce("intent", F.lit("none")).alias("intent")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("identifiers")).alias("identifiers"), F.sum(F.size("file_paths")).alias("paths"))


def pipe_search(spark, sf):
    """All user turns as requests against the collection of a source; some have none, or an unknown one.

    An analysis names the files that its query names; a new one names one file fewer.
    """
    points = stored(embed(_corpus(spark, sf, "start_line", "end_line").withColumn("collection", F.concat(F.lit("repo_local_"), "repo_id")).withColumnRenamed("chunk_key", "point_id")))  # as an index has them
    place = F.when(F.col("query_id") % 9 == 0, F.lit(None)).when(F.col("query_id") % 9 == 1, F.lit("/x/nowhere.zip")).otherwise(F.concat(F.lit("/x/src"), (F.col("query_id") % 20).cast("string"), F.lit(".zip")))
    q = fx.queries(spark, sf).withColumn("source_type", F.lit("zip")).withColumn("source_location", place.cast("string"))

    def analyse(asked):
        return asked.select("query_id", F.when(F.col("query_id") % 13 == 0, "UNAVAILABLE").otherwise("AVAILABLE").alias("analysis_status"), F.concat(F.lit("change "), "symbol").alias("proposal"), F.col("query").alias("text"), X.file_paths(F.col("query")).alias("files"))

    def again(failing):
        return failing.withColumn("files", F.filter("files", lambda f, i: i > 0))

    found = run_search(q, points, k=10, analyse=analyse, again=again)
    return found.select("query_id", "intent", "early_exit", "results", "top_file", "primary_rank", "target", "validation", "confidence", F.sha2("context", 256).alias("context_sha256"))


def stream_rate(spark, sf):
    """Deliveries by hour and type, over the rows at hand as the stream would count them."""
    d = fx.deliveries(spark, sf).where("delivery_id % 7 != 0").withColumn("outcome", F.col("event_type"))
    return rate(d).select(F.col("window.start").alias("hour"), "outcome", "n")


QUERIES = {
    f.__name__: f
    for f in (
        src_git_tree, flt_zip_path, flt_binary, prj_decode, flt_branch_name, flt_sanitize_query, flt_package_files, src_manifest_scroll, prj_paths_match, fn_aliases, agg_dedupe_max, agg_first_fix, set_intersect_terms, win_zip_limits,
        understand, pipe_search, stream_rate,
    )
}

from quarryloom.plans.search_queries import CORPUS_SQL  # noqa: E402
from quarryloom.plans.text_queries import ORACLE_SQL as TEXT_SQL  # noqa: E402

_PARTS = lambda c: f"CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, '|')) END"

ORACLE_SQL = {
    "understand": f"""SELECT coalesce(intent, 'none') AS intent, count(*) AS n, CAST(sum({_PARTS('identifiers')}) AS BIGINT) AS identifiers, CAST(sum({_PARTS('paths')}) AS BIGINT) AS paths
        FROM ({TEXT_SQL['fn_intent_fallback']}) i JOIN ({TEXT_SQL['fn_identifiers']}) USING (query_id) JOIN ({TEXT_SQL['fn_file_paths']}) USING (query_id) GROUP BY 1""",
    "src_git_tree": f"WITH {fx.FILES_SQL} SELECT file_path, sha1(content) AS blob_sha, CASE WHEN doc_id % 4 <> 0 THEN length(content) ELSE 0 END AS size FROM files WHERE doc_id % 6 <> 0",
    "flt_zip_path": "SELECT p_partkey FROM part WHERE p_partkey % 7 IN (0, 5, 6)",
    "flt_binary": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN strlen(text) < 8192 WHEN 1 THEN TRUE ELSE FALSE END AS is_binary FROM documents",
    "prj_decode": "SELECT doc_id, md5(text || 'end') AS digest FROM documents",
    "flt_branch_name": f"WITH {fx.DELIVERIES_SQL} SELECT delivery_id FROM once WHERE delivery_id % 7 <> 0",
    "flt_sanitize_query": "SELECT doc_id, CAST(CASE WHEN length(trim(text, ' ')) <= 2000 THEN length(trim(text, ' ')) END AS INT) AS n FROM documents",
    "flt_package_files": "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 4",
    "src_manifest_scroll": f"""WITH RECURSIVE {CORPUS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY chunk_key) AS n FROM corpus)
        SELECT repo_id, chunk_key FROM f WHERE n <= 500 AND length(content) % 7 = 0 QUALIFY row_number() OVER (PARTITION BY repo_id, chunk_hash ORDER BY chunk_key) = 1""",
    "prj_paths_match": "SELECT doc_id, doc_id % 3 <> 2 AS same FROM documents",
    "fn_aliases": f"""WITH {fx.FILES_SQL}, s AS (SELECT doc_id, lower(regexp_extract(content, '([A-Za-z]{{3,}})', 1)) AS a, 'doc_' || doc_id AS b FROM files)
        SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([a, CASE WHEN length(b) > 4 THEN b END], lambda x: x IS NOT NULL AND length(x) > 3))), '|') AS aliases FROM s""",
    "agg_dedupe_max": """SELECT source AS query_id, doc_id AS key, round(max((n_chars % 97)::DOUBLE / 97) OVER (PARTITION BY source, md5(text)), 9) AS rrf FROM documents QUALIFY row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) = 1""",
    "agg_first_fix": f"WITH {_ADV} SELECT audit_id, package, min(patched_version) AS patched_version FROM adv WHERE is_direct AND patched_version IS NOT NULL GROUP BY 1, 2",
    "set_intersect_terms": f"SELECT doc_id, len(list_filter(['the', 'de', 'licensed', 'password'], lambda x: list_contains({_SIMPLE.format('text')}, x))) / 4.0::DOUBLE AS share FROM documents",
    "win_zip_limits": f"WITH {fx.FILES_SQL}, w AS (SELECT repo_id, doc_id, count(*) OVER w AS n, CAST(sum(strlen(content)) OVER w AS BIGINT) AS bytes FROM files WINDOW w AS (PARTITION BY repo_id ORDER BY doc_id)) SELECT * FROM w WHERE n <= 30 AND bytes <= 60000",
    "stream_rate": f"WITH {fx.DELIVERIES_SQL} SELECT date_trunc('hour', received_at) AS hour, event_type AS outcome, count(*) AS n FROM once WHERE delivery_id % 7 <> 0 GROUP BY ALL",
}
