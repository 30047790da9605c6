"""Queries over patches, validation rounds, archives, serialised context, mixed values and work that is tried again."""

from __future__ import annotations

import datetime as dt
import io
import tempfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from quarryloom.functions import text as X
from quarryloom.functions.values import normalize_suggestion
from quarryloom.operators import context as C
from quarryloom.operators import patches as P
from quarryloom.operators import verify as V
from quarryloom.plans import fixtures as fx
from quarryloom.sources import files as A
from quarryloom.sources.staging import staged
from quarryloom.sources.tables import spread, table
from quarryloom.streaming.work import WorkLog


def _module(number):
    """A document's text between a first and a last line of its own."""
    return F.concat(F.lit("-- begin "), number, F.lit("\n"), F.coalesce(F.col("text"), F.lit("")), F.lit("\n-- end "), number)


def srch_patch(spark, sf):
    """Two verified changes of each document, of which one starts from a source that has moved since, applied as patches.

    Of every fifth document the changes meet; of every seventh a patch is cut off.
    """
    n = F.col("doc_id").cast("string")
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", _module(n).alias("source"))
    head = F.concat(F.lit("-- begin "), n, F.lit("\n"))
    tail = F.concat(F.lit("-- end "), n)
    changes = d.select(
        "source", "doc_id", F.explode(F.array(
            F.struct(F.lit(0).alias("k"), head.alias("old_code"), F.concat(head, F.lit("import a\nimport b\n")).alias("new_code")),
            F.struct(F.lit(1).alias("k"), F.when(F.col("doc_id") % 5 == 0, head).otherwise(tail).alias("old_code"), F.when(F.col("doc_id") % 5 == 0, F.lit("import c\n")).otherwise(F.concat(F.lit("stop "), n)).alias("new_code")),
        )).alias("c"),
    ).select((F.col("doc_id") * 2 + F.col("c.k")).alias("change_id"), F.lit("m.py").alias("file_path"), "source", F.lit(1).alias("base_line"), "c.old_code", "c.new_code")
    found = V.verify_changes(changes).where("status = 'verified'")
    cut = F.when(F.expr("change_id div 2") % 7 == 0, F.concat(F.lit("@@ -1,9 +1 @@\n"), F.col("patch"))).otherwise(F.col("patch"))
    patches = found.groupBy(F.expr("change_id div 2").alias("doc_id")).agg(F.collect_list(cut).alias("patches"))
    moved = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# new\r\n"), F.col("source"), F.lit("\n"))).otherwise(F.col("source"))
    out = P.apply_patches(d.select("doc_id", moved.alias("source")).join(patches, "doc_id"), key="doc_id")
    return out.select("doc_id", "hunks", "status", F.sha2("text", 256).alias("digest"))


def srch_validate(spark, sf):
    """Analyses of user turns that name files by the turn's words; each new one names one unknown file fewer.

    Some lack their proposal or are undecided at first, some are unavailable, some are not made anew.
    """
    q = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0))))
    bad = F.filter(words, lambda w: w >= "n")
    a = q.select(
        "query_id", F.when(F.col("query_id") % 13 == 0, "UNAVAILABLE").otherwise("AVAILABLE").alias("analysis_status"), F.element_at(F.array(*[F.lit(i) for i in P.PROPOSAL]), (F.col("query_id") % 3 + 1).cast("int")).alias("intent"),
        F.when(F.col("query_id") % 7 == 0, " ").otherwise("do this").alias("proposal"), F.when(F.col("query_id") % 5 == 0, "Wait, let me think").otherwise("It is clear").alias("summary"),
        F.transform(bad, lambda w: F.concat(F.lit("src/"), w, F.lit(".py"))).alias("unknown"), F.transform(F.array_except(words, bad), lambda w: F.concat(F.lit("src/"), w, F.lit(".py"))).alias("known"),
    )
    # read by each round's check
    a = staged(a)
    retrieved = a.select("query_id", F.explode("known").alias("file_path"))

    def check(pending):
        refs = V.unknown_files(pending.select("query_id", F.explode(F.concat("known", "unknown")).alias("file_ref")), retrieved)
        strange = refs.groupBy("query_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown file "), F.col("file_ref")))).alias("strange"))
        own = P.suggestion_errors(F.col("intent"), F.col("proposal"), F.col("summary"))
        return pending.join(strange, "query_id", "left").select("query_id", F.concat(own, F.coalesce("strange", F.array().cast("array<string>"))).alias("errors")).where(F.size("errors") > 0)

    def again(failing):
        left = F.filter("unknown", lambda r, i: i > 0)
        return failing.where("query_id % 11 != 0").withColumns({"proposal": F.lit("do that"), "summary": F.lit("It is clear"), "unknown": left})

    out = P.validate(a, check, again)
    return out.select("query_id", "validation", F.col("retries").cast("long").alias("retries"), F.size("errors").cast("long").alias("n_errors"), "early_exit")


#: Documents of an archive at most, and the size over which a member is left out.
IN_ARCHIVE, MEMBER = 40, 30_000


def _archives(spark, sf):
    """The documents as files in zip archives, so many by so many; every seventh has a member outside its folder, every eleventh is cut off."""
    f = fx.files(spark, sf).select("doc_id", "file_path", "content", F.concat_ws("/", "repo_id", (F.expr(f"doc_id div {IN_ARCHIVE}")).cast("string")).alias("archive"), F.expr(f"doc_id div {IN_ARCHIVE}").alias("n"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows.sort_values("doc_id").itertuples():
                z.writestr(r.file_path, r.content or "")
            if rows.n.iloc[0] % 7 == 3:
                z.writestr("../outside.py", "x")
        data = out.getvalue()
        return pd.DataFrame({"archive": [rows.archive.iloc[0]], "content": [data[: len(data) // 2] if rows.n.iloc[0] % 11 == 5 else data]})

    return f.groupBy("archive").applyInPandas(packed, "archive string, content binary")


def zip_ingest(spark, sf):
    """The source files of all archives with their digests and languages; refused archives with the reason."""
    m = A.archive_members(_archives(spark, sf), most_file_bytes=MEMBER)
    kept = m.where(F.col("error").isNotNull() | X.is_source_file(F.col("file_path")))
    kind = F.when(F.col("error").startswith("unsafe path"), "unsafe path").when(F.col("error").isNotNull(), "damaged")
    return kept.select("archive", "file_path", "size", F.when(F.col("error").isNull(), F.sha2("content", 256)).alias("file_hash"), F.when(F.col("error").isNull(), X.language_of(F.col("file_path"))).alias("language"), kind.alias("refused"))


def fn_toon(spark, sf):
    """Documents by fives as a context each, whole texts as the values of columns that only some contexts have."""
    f = fx.files(spark, sf)
    g = F.expr("doc_id div 5")
    rows = f.select(
        g.alias("query_id"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 9 != 0, F.col("file_path")).alias("file_path"), F.lit(3).alias("start_line"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") + 3).alias("end_line"),
        F.when((g % 2 == 0) & (F.col("doc_id") % 3 == 0), F.col("content")).alias("function_name"), F.when(g % 3 == 0, F.col("doc_id").cast("string")).otherwise("").alias("class_name"),
        F.when((g % 4 == 0) & (F.col("doc_id") % 2 == 0), F.lit("- a")).alias("chunk_type"), F.lit(None).cast("string").alias("repository"),
    )
    return C.toon(rows, group=["query_id"]).select("query_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


def fn_normalize_suggestion(spark, sf):
    """Whole texts as plain strings and within objects and lists, as JSON and as Python writes them."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"""[\x00-\x1f"'\\]""", " ").alias("t"))
    shapes = [
        F.to_json(F.struct(F.concat(F.lit(" a"), F.col("t"), F.lit("z ")).alias("description"), F.col("doc_id").alias("id"))),
        F.concat(F.lit('{"note":"'), F.col("t"), F.lit('","n":[1,2.5,true,null]}')),
        F.concat(F.lit("{'description': 'a"), F.col("t"), F.lit("z', 'n': None}")),
        F.concat(F.lit("  ['"), F.col("t"), F.lit("', ('x', True)]\n")),
        F.concat(F.lit("\t a"), F.col("t"), F.lit("z \n")),
        F.lit(" \t"),
        F.concat(F.lit("{not read: a"), F.col("t"), F.lit("z}")),
        F.lit('{"description": {"a": 1}}'),
        F.lit('{"description": "  "}'),
        F.lit("12"),
    ]
    value = F.lit(None).cast("string")
    for k, s in enumerate(shapes):
        value = F.when(F.col("doc_id") % (len(shapes) + 1) == k, s).otherwise(value)
    return d.select("doc_id", F.md5(normalize_suggestion(value)).alias("digest"))


def stream_retries(spark, sf):
    """The accepted deliveries as work: a repository's fail so often as its number says; all rounds, a minute apart."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp()}"
    log, start = WorkLog(spark, f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"), dt.datetime(2030, 1, 1)
    d = fx.deliveries(spark, sf).join(fx.repos(spark, sf), "github_repo_id").select("delivery_id", "repo_id", "received_at", "payload")
    log.receive(d, now=start)
    fails = lambda due: due.select("delivery_id", F.when(F.col("attempts") < F.col("repo_id").cast("long") % 6, F.concat(F.lit("attempt "), (F.col("attempts") + 1).cast("string"))).alias("error"))
    for k in range(log.retries + 1):
        log.work_off(fails, now=start + k * log.pause)
    return log.progress().select("repo_id", "done", "dead", "last_delivery_id")


QUERIES = {f.__name__: f for f in (srch_patch, srch_validate, zip_ingest, fn_toon, fn_normalize_suggestion, stream_retries)}

from quarryloom.plans.text_queries import ORACLE_SQL as TEXT_SQL  # noqa: E402

_OPEN = "[\\x00-\\x1f\"''\\\\]"
_Q = lambda c: f"""CASE WHEN regexp_matches({c}, '^$|^[ \\t\\n\\f\\r]|[ \\t\\n\\f\\r]$|^(true|false|null)$|^-|^[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$|[,:"\\\\\\[\\]{{}}\\n\\r\\t]') THEN '"' || replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' ELSE {c} END"""

ORACLE_SQL = {
    "srch_patch": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id::VARCHAR AS n FROM documents),
        s AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'malformed' WHEN doc_id % 5 = 0 THEN 'rejected' ELSE 'applied' END AS status, CASE WHEN doc_id % 3 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS e, chr(10) AS e0 FROM d)
        SELECT doc_id, CAST(CASE WHEN status = 'malformed' THEN 0 ELSE 2 END AS INT) AS hunks, status,
          CASE WHEN status = 'applied' THEN sha256(CASE WHEN doc_id % 3 = 0 THEN '# new' || e ELSE '' END || '-- begin ' || n || e0 || 'import a' || e || 'import b' || e || t || chr(10) || 'stop ' || n || CASE WHEN doc_id % 3 = 0 THEN e ELSE '' END) END AS digest FROM s""",
    "srch_validate": """WITH q AS (SELECT conv_id * 1000 + turn AS query_id, len(list_filter(list_distinct(regexp_extract_all(coalesce(text, ''), '[a-z]{9,}')), lambda w: w >= 'n')) AS b FROM conversations WHERE role = 'user'),
        r AS (SELECT *, CAST(query_id % 5 = 0 AS INT) + CAST(query_id % 7 = 0 AS INT) AS own FROM q), s AS (SELECT *, greatest(b, least(own, 1)) AS need FROM r)
        SELECT query_id, CASE WHEN query_id % 13 = 0 THEN 'unavailable' WHEN need = 0 THEN 'passed' WHEN query_id % 11 = 0 THEN 'unavailable' WHEN need <= 2 THEN 'passed' ELSE 'failed' END AS validation,
          CAST(CASE WHEN query_id % 13 = 0 OR need = 0 THEN 0 WHEN query_id % 11 = 0 THEN 1 ELSE least(need, 2) END AS BIGINT) AS retries,
          CAST(CASE WHEN query_id % 13 = 0 THEN 1 WHEN need = 0 THEN 0 WHEN query_id % 11 = 0 THEN own + b WHEN need <= 2 THEN 0 ELSE b - 2 END AS BIGINT) AS n_errors,
          CASE WHEN query_id % 13 <> 0 AND query_id % 11 <> 0 AND need > 2 THEN 'EARLY_EXIT_D' END AS early_exit FROM s""",
    "zip_ingest": f"""WITH {fx.FILES_SQL}, a AS (SELECT *, doc_id // {IN_ARCHIVE} AS n, repo_id || '/' || (doc_id // {IN_ARCHIVE}) AS archive FROM files)
        SELECT DISTINCT archive, NULL AS file_path, CAST(NULL AS BIGINT) AS size, NULL AS file_hash, NULL AS language, CASE WHEN n % 11 = 5 THEN 'damaged' ELSE 'unsafe path' END AS refused FROM a WHERE n % 7 = 3 OR n % 11 = 5
        UNION ALL SELECT archive, a.file_path, strlen(coalesce(content, '')), sha256(coalesce(content, '')), CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' ELSE 'typescript' END, NULL FROM a WHERE NOT (n % 7 = 3 OR n % 11 = 5) AND strlen(coalesce(content, '')) <= {MEMBER} AND doc_id IN (SELECT doc_id FROM ({TEXT_SQL['flt_source_files']}))""",
    "fn_toon": f"""WITH {fx.FILES_SQL}, r AS (SELECT doc_id, doc_id // 5 AS g, CASE WHEN doc_id % 9 <> 0 THEN file_path ELSE 'unknown' END AS file, CASE WHEN doc_id % 4 <> 0 THEN '3-' || (doc_id + 3) ELSE '?' END AS lines,
          CASE WHEN (doc_id // 5) % 2 = 0 AND doc_id % 3 = 0 THEN coalesce(content, '') ELSE '' END AS fn, CASE WHEN (doc_id // 5) % 3 = 0 THEN doc_id::VARCHAR ELSE '' END AS cl, CASE WHEN (doc_id // 5) % 4 = 0 AND doc_id % 2 = 0 THEN '- a' ELSE '' END AS ty FROM files),
        h AS (SELECT *, bool_or(fn <> '') OVER (PARTITION BY g) AS hf, bool_or(cl <> '') OVER (PARTITION BY g) AS hc, bool_or(ty <> '') OVER (PARTITION BY g) AS ht FROM r),
        t AS (SELECT g, '[' || count(*) || ']{{file,lines' || CASE WHEN bool_or(hf) THEN ',function' ELSE '' END || CASE WHEN bool_or(hc) THEN ',class' ELSE '' END || CASE WHEN bool_or(ht) THEN ',type' ELSE '' END || '}}:'
          || string_agg(chr(10) || '  ' || {_Q('file')} || ',' || {_Q('lines')} || CASE WHEN hf THEN ',' || {_Q('fn')} ELSE '' END || CASE WHEN hc THEN ',' || {_Q('cl')} ELSE '' END || CASE WHEN ht THEN ',' || {_Q('ty')} ELSE '' END, '' ORDER BY doc_id) AS text FROM h GROUP BY g)
        SELECT g AS query_id, md5(text) AS digest, CAST(length(text) AS INT) AS n FROM t""",
    "fn_normalize_suggestion": f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_OPEN}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, md5(CASE doc_id % 11 WHEN 0 THEN 'a' || t || 'z' WHEN 1 THEN '{{"note": "' || t || '", "n": [1, 2.5, true, null]}}' WHEN 2 THEN 'a' || t || 'z' WHEN 3 THEN '["' || t || '", ["x", true]]' WHEN 4 THEN 'a' || t || 'z'
          WHEN 6 THEN '{{not read: a' || t || 'z}}' WHEN 7 THEN '{{''a'': 1}}' WHEN 9 THEN '12' END) AS digest FROM d""",
    "stream_retries": f"""WITH {fx.DELIVERIES_SQL}, {fx.REPOS_SQL}, w AS (SELECT delivery_id, received_at, repo_id, repo_id % 6 <= 3 AS good FROM once JOIN repos USING (github_repo_id))
        SELECT repo_id::VARCHAR AS repo_id, CAST(count(*) FILTER (good) AS BIGINT) AS done, CAST(count(*) FILTER (NOT good) AS BIGINT) AS dead, (arg_max(delivery_id, (received_at, delivery_id)) FILTER (good)) AS last_delivery_id FROM w GROUP BY repo_id""",
}
