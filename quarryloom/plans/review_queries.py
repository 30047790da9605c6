"""Queries of context building, identification, audits and verification, on tables of the right shape."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryloom.functions import text as X
from quarryloom.operators import audit as A
from quarryloom.operators import context as C
from quarryloom.operators import identify as D
from quarryloom.operators import search as S
from quarryloom.operators import verify as V
from quarryloom.plans import fixtures as fx
from quarryloom.plans.text_queries import _SIMPLE, _quoted
from quarryloom.sources.tables import table


def _ranges(spark, sf):
    """Order lines as retrieved chunks with line ranges."""
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS query_id", "l_suppkey % 2 AS file", "l_linenumber AS ord", "cast(l_partkey % 12 AS INT) AS start_line", "cast(l_partkey % 12 + floor(l_quantity) % 9 AS INT) AS end_line")


def agg_overlap(spark, sf):
    return C.drop_overlaps(_ranges(spark, sf), group=["query_id", "file"])


def win_budget(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.least(F.length("text"), F.lit(1500)).alias("n"))
    return C.within_budget(d, group=["source"], order=["doc_id"], length=F.col("n"), most=C.TOTAL_CHARS, rows=8).select("source", "doc_id")


def join_related_role(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS h", "p_partkey div 10 * 10 AS primary", "array(p_partkey - 1, p_partkey * 2) AS rel")
    prim = p.where("h = primary").select(F.col("h").alias("primary"), F.col("rel").alias("primary_rel"))
    j = p.join(prim, "primary", "left")
    return j.select("h", C.role(F.col("h") == F.col("primary"), F.col("rel"), F.col("primary_rel"), F.col("h"), F.col("primary")).alias("role"))


def sort_context(spark, sf):
    """Parts of a brand: the primary one (largest) first, the others by falling price."""
    p = table(spark, sf, "part")
    primary = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")) == 1
    w = Window.partitionBy("p_brand").orderBy(F.desc("is_primary"), F.desc("p_retailprice"), "p_partkey")
    return p.withColumn("is_primary", primary).select("p_brand", "p_partkey", F.row_number().over(w).alias("pos")).where("pos <= 8")


def _candidates(spark, sf):
    return table(spark, sf, "part").selectExpr("p_brand AS query_id", "p_partkey AS ord", "split(p_type, ' ')[0] AS name", "concat('Src/', p_size % 7, '/Mod', p_partkey % 3, '.py') AS file_path", "p_retailprice / 2000 AS score")


def agg_conflict(spark, sf):
    return D.conflicts(_candidates(spark, sf)).select("query_id", "symbol", "file", "ord", F.round("score", 6).alias("score"), "files")


def flt_plausible(spark, sf):
    c = table(spark, sf, "orders").selectExpr("o_custkey AS query_id", "o_orderkey AS candidate", "if(o_custkey % 3 = 0, 'a.py', concat('f', o_orderkey % 3, '.py')) AS file_path", "o_totalprice / 500000 AS score", "o_orderkey % 4 = 0 AS has_symbol")
    return D.plausible(c).select("query_id", "candidate")


def score_disambiguation(spark, sf):
    """Every query with a candidate whose path, class and symbol depend on its id."""
    q = fx.queries(spark, sf)
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("query_id") % len(xs) + 1).cast("int"))
    path = pick(("src/app/user_service.py", "lib/data_loader.ts", "pkg/tools/parser2.py", "config.yaml", "acme/tools/upload.py"))
    score = D.evidence_score(
        query=F.col("query"), identifiers=X.identifiers(F.col("query")), keywords=X.keywords(F.col("query")), file_paths=X.file_paths(F.col("query")), path=path, symbol=pick(("getUserName", "process_records", "x")),
        class_name=pick(("FileUploadController", "Parser2", "HTTPServer", "")), element_path=F.lit(None).cast("string"),
    )
    return q.select("query_id", score.alias("evidence"))


def win_gap(spark, sf):
    c = table(spark, sf, "orders").selectExpr("o_custkey AS query_id", "o_orderkey AS candidate", "cast(o_orderkey % 12 AS DOUBLE) AS evidence", "o_totalprice / 500000 AS score", "o_custkey % 2 = 0 AS conflict")
    return D.decide(c).select("query_id", "outcome", "candidate", "gap")


def ambiguity_rows(spark, sf):
    c = table(spark, sf, "orders").selectExpr("o_custkey % 50 AS query_id", "o_orderkey AS candidate", "cast(o_orderkey % 12 AS DOUBLE) AS evidence", "o_totalprice AS score")
    return D.ambiguous_candidates(c).select("query_id", "candidate", "rank")


def pick_primary(spark, sf):
    chunks = _candidates(spark, sf)
    elements = chunks.groupBy("query_id").agg(F.min_by("name", "ord").alias("n"), F.max_by("file_path", "ord").alias("f"), F.min("ord").alias("m"))
    e = elements.select("query_id", F.when(F.col("m") % 3 != 0, F.upper("n")).alias("element_name"), F.when(F.col("m") % 2 == 0, F.lower("f")).alias("element_file"))
    return D.primary_chunk(chunks, e)


def _audits(spark, sf):
    o = table(spark, sf, "orders")
    text = (
        "concat('{\"vulnerabilities\":{\"pkg', o_orderkey % 7, '\":{\"severity\":\"', if(o_orderkey % 2 = 0, 'high', 'low'), '\",\"range\":\"<2\",\"isDirect\":true,\"via\":[{\"source\":', o_orderkey, ',\"title\":\"Bad\",\"severity\":\"moderate\",\"url\":\"u\"},\"other\",{\"source\":9,\"title\":\"Worse\",\"severity\":\"',"
        " if(o_orderkey % 3 = 0, 'critical', 'medium'), '\",\"range\":\"<1.5\"}],\"fixAvailable\":{\"name\":\"p\",\"version\":\" 2.0.', o_orderkey % 5, ' \"}},\"lib', o_orderkey % 3, '\":{\"severity\":\"info\",\"via\":[\"pkg\"],\"fixAvailable\":true}}}')"
    )
    return o.selectExpr("o_orderkey AS audit_id", f"{text} AS report")


def _direct(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS audit_id", "concat('lib', o_orderkey % 3) AS package", "'^1.0.0' AS version")


def fn_audit_explode(spark, sf):
    return A.advisories(_audits(spark, sf), _direct(spark, sf)).select("audit_id", "package", "current_version", "severity", "vulnerable_range", "patched_version", "is_direct", "title")


def agg_vuln_group(spark, sf):
    return A.by_package(A.advisories(_audits(spark, sf), _direct(spark, sf))).select("audit_id", "package", "advisories", "current_version", "severity", "patched_version")


def sort_vuln(spark, sf):
    q = _audits(spark, sf).select("audit_id", F.when(F.col("audit_id") % 5 == 0, "fix PKG3 now").otherwise("fix all").alias("query"))
    return A.select_fix(A.advisories(_audits(spark, sf), _direct(spark, sf)), q).select("audit_id", "package", "title", "severity")


def fn_manifest_bump(spark, sf):
    m = _audits(spark, sf).select("audit_id", F.format_string('{\n  "name": "x",\n  "dependencies": {\n    "pkg%d": "%s1.0.0",\n    "lib0": "~2.0.%d"\n  }\n}', F.col("audit_id") % 7, F.when(F.col("audit_id") % 2 == 0, "^").otherwise(""), F.col("audit_id") % 5).alias("content"))
    fixes = A.by_package(A.advisories(_audits(spark, sf), _direct(spark, sf))).where("patched_version is not null").select("audit_id", "package", "patched_version")
    return A.bump(m, fixes).select("audit_id", "package", "line_number", "new_code")


def agg_manifest(spark, sf):
    """Documents rebuilt from halves that overlap by a line; a third of them lack their first half."""
    d = table(spark, sf, "documents").select("doc_id", F.split(F.regexp_replace("text", "\n+$", ""), "\n").alias("l")).where(F.size("l") >= 4)
    half = F.floor(F.size("l") / 2).cast("int")
    first = d.where("doc_id % 3 != 0").select("doc_id", F.lit(1).alias("start_line"), F.lit(0).alias("ord"), F.array_join(F.slice("l", F.lit(1), half + 1), "\n").alias("content"))
    second = d.select("doc_id", (half + 1).alias("start_line"), F.lit(1).alias("ord"), F.array_join(F.slice("l", half + 1, F.size("l")), "\n").alias("content"))
    return A.rebuild(first.unionByName(second), key="doc_id").select("doc_id", F.md5("content").alias("digest"), "is_complete", "is_json")


def join_lock_versions(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey div 10 AS audit_id", "concat('p', p_partkey) AS package", "concat('^', p_size) AS version")
    a = table(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey div 10 AS audit_id", "concat('node_modules/p', p_partkey) AS name", "if(p_partkey % 2 = 0, '', concat(p_size, '.1')) AS version")
    b = table(spark, sf, "part").where("p_partkey % 4 = 0").selectExpr("p_partkey div 10 AS audit_id", "concat('p', p_partkey) AS name", "concat(p_size, '.2') AS version")
    return A.resolved_versions(d, a, b).select("package", "version")


def join_evidence(spark, sf):
    refs = table(spark, sf, "lineitem").selectExpr("l_orderkey AS query_id", "concat('Dir', l_linenumber, '/File', l_partkey % 9, '.py') AS file_ref")
    chunks = table(spark, sf, "lineitem").where("l_linenumber = 1").selectExpr("l_orderkey AS query_id", "concat('dir', l_suppkey % 3, '/file', l_suppkey % 9, '.py') AS file_path")
    return V.unknown_files(refs, chunks)


def join_code_exists(spark, sf):
    d = table(spark, sf, "documents")
    code = F.element_at(F.array(F.lit("the"), F.lit("Password(x).token"), F.lit("zzzz.qqqq()"), F.lit("is"), F.lit("abc")), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", V.code_is_known(code, F.col("text")).alias("known"))


def fn_looks_like_code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.looks_like_code(F.col("text")).alias("code"))


def _states(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'unavailable' ELSE 'skipped' END AS validation", "o_orderkey % 5 = 0 AS ambiguous", "if(o_orderkey % 11 = 0, 'EARLY_EXIT_D', NULL) AS early_exit",
        "o_orderkey % 7 != 0 AS has_chunks", "o_orderkey % 3 != 0 AS has_primary", "element_at(array('ADD_FEATURE', 'FIX_BUG', 'REFACTOR', 'RETRIEVE'), cast(o_orderkey % 4 + 1 AS INT)) AS intent",
        "sequence(1, cast(o_orderkey % 6 + 1 AS INT)) AS affected", "element_at(array('FIELD_MAPPING_MISMATCH', 'WRONG_FIELD_REFERENCE', 'NONE'), cast(o_orderkey % 3 + 1 AS INT)) AS issue",
    )


def score_confidence(spark, sf):
    s = _states(spark, sf)
    level = V.confidence(**{c: F.col(c) for c in ("validation", "ambiguous", "early_exit", "has_chunks", "has_primary")})
    return s.select("o_orderkey", level.alias("confidence"), V.is_safe(F.col("validation"), level).alias("safe"), V.risk(F.col("affected"), F.col("validation"), F.col("intent")).alias("risk"), V.action(F.col("intent"), F.col("issue")).alias("action"))


def fn_find_code(spark, sf):
    """A stretch of each document found again in it, exactly once or more often."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("change_id"), F.lit("a.py").alias("file_path"), F.col("text").alias("source"), F.lit(10).alias("base_line"), F.substring("text", 5, 12).alias("old_code"), F.lit("new").alias("new_code"))
    return V.verify_changes(d).select("change_id", "matches", "start_line", "status")


def score_bug(spark, sf):
    """Documents of a source as two result sets for one report each."""
    d = table(spark, sf, "documents")
    r = d.selectExpr("source AS query_id", "doc_id % 2 AS result_set", "doc_id AS chunk_key", "concat(source, '/file_', doc_id % 4, '.py') AS file_path", "'' AS symbol", "text AS content", "cast(doc_id AS DOUBLE) AS score")
    ranked = r.withColumn("rank0", F.row_number().over(Window.partitionBy("query_id", "result_set").orderBy("chunk_key")) - 1)
    signals = r.select("query_id").distinct().withColumn("signal_terms", F.array(F.lit("the"), F.lit("of"), F.lit("password"), F.lit("status")))
    return S.bug_scores(ranked, signals).select("query_id", "chunk_key", F.round("bug_score", 6).alias("bug_score"), "related")


def join_bug_refs(spark, sf):
    """Which documents of a source name another's file stem or symbol (a word of theirs) as a whole word."""
    d = table(spark, sf, "documents")
    r = d.selectExpr("source AS query_id", "0L AS result_set", "doc_id AS chunk_key", "concat(source, '/doc', doc_id, '.py') AS file_path", "regexp_extract(text, '([a-z]{6,})', 1) AS symbol", "text AS content", "1.0D AS score", "0 AS rank0")
    signals = r.select("query_id").distinct().withColumn("signal_terms", F.array().cast("array<string>"))
    return S.bug_scores(r, signals).where("related > 0").select("query_id", "chunk_key", "related")


QUERIES = {
    f.__name__: f
    for f in (
        agg_overlap, win_budget, join_related_role, sort_context, agg_conflict, flt_plausible, score_disambiguation, win_gap, ambiguity_rows, pick_primary, fn_audit_explode, agg_vuln_group, sort_vuln, fn_manifest_bump,
        agg_manifest, join_lock_versions, join_evidence, join_code_exists, fn_looks_like_code, score_confidence, fn_find_code, score_bug, join_bug_refs,
    )
}

_CAND = "cand AS (SELECT p_brand AS query_id, p_partkey AS ord, string_split(p_type, ' ')[1] AS name, 'Src/' || p_size % 7 || '/Mod' || p_partkey % 3 || '.py' AS file_path, p_retailprice / 2000 AS score FROM part)"
_SEV = "CASE lower({0}) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'info' THEN 0 ELSE -1 END"
_ADV = """o AS (SELECT o_orderkey AS k FROM orders),
adv AS (SELECT k AS audit_id, 'pkg' || k % 7 AS package, 0 AS nth, 'unknown' AS current_version, 'moderate' AS severity, '<2' AS vulnerable_range, '2.0.' || k % 5 AS patched_version, true AS is_direct, 'Bad' AS title FROM o
  UNION ALL SELECT k, 'pkg' || k % 7, 1, 'unknown', CASE WHEN k % 3 = 0 THEN 'critical' ELSE 'medium' END, '<1.5', '2.0.' || k % 5, true, 'Worse' FROM o
  UNION ALL SELECT k, 'lib' || k % 3, 0, CASE WHEN k % 4 = 0 THEN '^1.0.0' ELSE 'unknown' END, 'info', 'unknown', NULL, k % 4 = 0, 'lib' || k % 3 || ' vulnerability' FROM o)"""
_MARKS = " OR ".join("contains(v, '" + m.replace("'", "''") + "')" for m in V.CODE_MARKERS)
ORACLE_SQL = {
    "agg_overlap": """WITH RECURSIVE r AS (SELECT l_orderkey AS query_id, l_suppkey % 2 AS file, list({'place': l_linenumber, 'kept': l_linenumber, 's': CAST(l_partkey % 12 AS INT), 'e': CAST(l_partkey % 12 + floor(l_quantity) % 9 AS INT)} ORDER BY l_linenumber, l_partkey % 12, floor(l_quantity) % 9) AS rows FROM lineitem GROUP BY ALL),
        f AS (SELECT query_id, file, 1 AS i, [rows[1]] AS kept FROM r
          UNION ALL SELECT query_id, file, i + 1, CASE WHEN at_ IS NULL THEN list_append(kept, x) ELSE list_transform(kept, lambda k, n: CASE WHEN n = at_ AND x.e - x.s > k.e - k.s THEN {'place': k.place, 'kept': x.kept, 's': x.s, 'e': x.e} ELSE k END) END
          FROM (SELECT f.query_id, f.file, f.i, f.kept, r.rows[f.i + 1] AS x, list_filter(range(1, len(f.kept) + 1), lambda n: least(f.kept[n].e, r.rows[f.i + 1].e) - greatest(f.kept[n].s, r.rows[f.i + 1].s) + 1 > 0
            AND least(f.kept[n].e, r.rows[f.i + 1].e) - greatest(f.kept[n].s, r.rows[f.i + 1].s) + 1 >= 0.8::DOUBLE * least(f.kept[n].e - f.kept[n].s + 1, r.rows[f.i + 1].e - r.rows[f.i + 1].s + 1))[1] AS at_ FROM f JOIN r USING (query_id, file) WHERE f.i < len(r.rows))),
        done AS (SELECT f.query_id, f.file, unnest(kept) AS k FROM f JOIN r USING (query_id, file) WHERE f.i = len(r.rows))
        SELECT query_id, file, k.place AS ord, k.kept AS kept_ord, k.s AS start_line, k.e AS end_line FROM done""",
    "win_budget": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER w AS r, sum(least(length(text), 1500)) OVER w AS s FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE r <= 8 AND s <= 5000",
    "join_related_role": """WITH p AS (SELECT p_partkey AS h, p_partkey // 10 * 10 AS pr FROM part) SELECT h, CASE WHEN h = pr THEN 'PRIMARY' WHEN pr IN (SELECT h FROM p) AND (h IN (pr - 1, pr * 2) OR pr IN (h - 1, h * 2)) THEN 'RELATED'
        WHEN pr NOT IN (SELECT h FROM p) AND FALSE THEN 'RELATED' ELSE 'SUPPORTING' END AS role FROM p""",
    "sort_context": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1 AS is_primary FROM part)
        SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY is_primary DESC, p_retailprice DESC, p_partkey) AS INT) AS pos FROM p QUALIFY pos <= 8""",
    "agg_conflict": f"""WITH {_CAND}, b AS (SELECT query_id, lower(name) AS symbol, lower(file_path) AS file, ord, score FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, lower(name), lower(file_path) ORDER BY score DESC, ord) = 1)
        SELECT query_id, symbol, file, ord, round(score, 6) AS score, count(*) OVER (PARTITION BY query_id, symbol) AS files FROM b QUALIFY files >= 2""",
    "flt_plausible": """WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS candidate, CASE WHEN o_custkey % 3 = 0 THEN 'a.py' ELSE 'f' || o_orderkey % 3 || '.py' END AS f, o_totalprice / 500000 AS score, o_orderkey % 4 = 0 AS s FROM orders),
        p AS (SELECT * FROM (SELECT *, bool_or(s) OVER (PARTITION BY query_id) AS anys FROM c) WHERE s OR NOT anys), w AS (SELECT query_id, count(DISTINCT f) AS files, max(score) AS best FROM p GROUP BY 1)
        SELECT query_id, candidate FROM p JOIN w USING (query_id) WHERE files > 1 OR score >= best - 0.20::DOUBLE OR score >= 0.70::DOUBLE * best OR (s AND score >= 0.30::DOUBLE)""",
    "win_gap": """WITH c AS (SELECT o_custkey AS query_id, o_orderkey AS candidate, CAST(o_orderkey % 12 AS DOUBLE) AS evidence, o_totalprice / 500000 AS score, o_custkey % 2 = 0 AS conflict FROM orders),
        t AS (SELECT *, lead(evidence) OVER w AS n, lead(score) OVER w AS ns, row_number() OVER w AS r FROM c WINDOW w AS (PARTITION BY query_id ORDER BY evidence DESC, score DESC, candidate))
        SELECT query_id, CASE WHEN n IS NULL OR (evidence > 0 AND evidence - n >= 3) OR (NOT conflict AND score - ns >= 0.20::DOUBLE AND (ns <= 0 OR ns < 0.65::DOUBLE * score)) THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS outcome, candidate, evidence - coalesce(n, 0) AS gap FROM t WHERE r = 1""",
    "ambiguity_rows": "SELECT o_custkey % 50 AS query_id, o_orderkey AS candidate, CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey % 12 DESC, o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders QUALIFY rank <= 10",
    "pick_primary": f"""WITH {_CAND}, e AS (SELECT query_id, CASE WHEN min(ord) % 3 <> 0 THEN lower(arg_min(name, ord)) END AS n, CASE WHEN min(ord) % 2 = 0 THEN lower(arg_max(file_path, ord)) END AS f FROM cand GROUP BY 1),
        t AS (SELECT query_id, ord, score, CASE WHEN f = lower(file_path) AND n = lower(name) THEN 1 WHEN f = lower(file_path) THEN 2 WHEN n = lower(name) THEN 3 ELSE 4 END AS tier FROM cand JOIN e USING (query_id))
        SELECT query_id, ord, tier FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 1 THEN 0 ELSE -score END, ord) = 1""",
    "fn_audit_explode": f"WITH {_ADV} SELECT audit_id, package, current_version, severity, vulnerable_range, patched_version, is_direct, title FROM adv",
    "agg_vuln_group": f"""WITH {_ADV} SELECT audit_id, package, count(*) AS advisories, arg_min(current_version, nth) AS current_version, (list(severity ORDER BY {_SEV.format('severity')} DESC, nth))[1] AS severity, min(patched_version) AS patched_version FROM adv WHERE is_direct GROUP BY 1, 2""",
    "sort_vuln": f"""WITH {_ADV}, e AS (SELECT *, audit_id % 5 = 0 AND package = 'pkg3' AS named FROM adv WHERE is_direct AND patched_version IS NOT NULL), f AS (SELECT *, bool_or(named) OVER (PARTITION BY audit_id) AS anyn FROM e)
        SELECT audit_id, package, title, severity FROM f WHERE named OR NOT anyn QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY {_SEV.format('severity')} DESC, lower(package), lower(title), nth) = 1""",
    "fn_manifest_bump": """SELECT o_orderkey AS audit_id, 'pkg' || o_orderkey % 7 AS package, 4 AS line_number, '    "pkg' || o_orderkey % 7 || '": "' || CASE WHEN o_orderkey % 2 = 0 THEN '^' ELSE '' END || '2.0.' || o_orderkey % 5 || '",' AS new_code FROM orders""",
    "agg_manifest": """WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\\n+$', ''), chr(10)) AS l FROM documents) SELECT doc_id, md5(array_to_string(CASE WHEN doc_id % 3 <> 0 THEN l ELSE l[len(l) // 2 + 1 :] END, chr(10))) AS digest, doc_id % 3 <> 0 AS is_complete, false AS is_json FROM d WHERE len(l) >= 4""",
    "join_lock_versions": "SELECT 'p' || p_partkey AS package, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN p_size || '.1' WHEN p_partkey % 4 = 0 THEN p_size || '.2' ELSE '^' || p_size END AS version FROM part",
    "join_evidence": """WITH c AS (SELECT l_orderkey AS query_id, 'dir' || l_suppkey % 3 || '/file' || l_suppkey % 9 || '.py' AS p, 'file' || l_suppkey % 9 || '.py' AS b FROM lineitem WHERE l_linenumber = 1)
        SELECT l_orderkey AS query_id, 'Dir' || l_linenumber || '/File' || l_partkey % 9 || '.py' AS file_ref FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = l.l_orderkey AND (c.b = 'file' || l.l_partkey % 9 || '.py' OR c.p = 'dir' || l.l_linenumber || '/file' || l.l_partkey % 9 || '.py'))""",
    "join_code_exists": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN contains(lower(text), 'password') OR contains(lower(text), 'token') WHEN 2 THEN contains(lower(text), 'zzzz') OR contains(lower(text), 'qqqq') ELSE TRUE END AS known FROM documents",
    "fn_looks_like_code": f"SELECT doc_id, contains(v, chr(10)) OR contains(v, chr(13)) OR {_MARKS} AS code FROM (SELECT doc_id, lower(text) AS v FROM documents)",
    "score_confidence": """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'unavailable' ELSE 'skipped' END AS v, (['ADD_FEATURE', 'FIX_BUG', 'REFACTOR', 'RETRIEVE'])[o_orderkey % 4 + 1] AS i FROM orders),
        c AS (SELECT *, CASE WHEN v IN ('failed', 'unavailable') OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'low' WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'low' WHEN v = 'passed' THEN 'high' ELSE 'medium' END AS confidence FROM s)
        SELECT o_orderkey, confidence, v = 'passed' AND confidence IN ('high', 'medium') AS safe, CASE WHEN o_orderkey % 6 + 1 > 3 OR v = 'failed' THEN 'high' WHEN i IN ('ADD_FEATURE', 'REFACTOR') THEN 'medium' ELSE 'low' END AS risk,
        CASE WHEN i = 'FIX_BUG' AND o_orderkey % 3 = 0 THEN 'SCHEMA_MAPPING_FIX' WHEN i = 'FIX_BUG' AND o_orderkey % 3 = 1 THEN 'FIELD_REFERENCE_CORRECTION' WHEN i = 'FIX_BUG' THEN 'BUG_REMEDIATION' WHEN i = 'ADD_FEATURE' THEN 'FEATURE_IMPLEMENTATION' WHEN i = 'REFACTOR' THEN 'CODE_REFACTORING' ELSE 'CODE_MODIFICATION' END AS action FROM c""",
    "fn_find_code": """WITH d AS (SELECT doc_id, text, substr(text, 5, 12) AS o FROM documents), n AS (SELECT *, CASE WHEN length(o) = 0 THEN 0 ELSE (length(text) - length(replace(text, o, ''))) // length(o) END AS n FROM d)
        SELECT doc_id AS change_id, CAST(n AS INT) AS matches, CAST(CASE WHEN n = 1 THEN 10 + length(substr(text, 1, instr(text, o) - 1)) - length(replace(substr(text, 1, instr(text, o) - 1), chr(10), '')) ELSE 0 END AS INT) AS start_line,
        CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 0 THEN 'not_found' ELSE 'verified' END AS status FROM n""",
    "score_bug": f"""WITH r AS (SELECT source AS q, doc_id % 2 AS rs, doc_id, source || '/file_' || doc_id % 4 || '.py' AS p, text AS c FROM documents),
        k AS (SELECT *, 1.0::DOUBLE - (row_number() OVER (PARTITION BY q, rs ORDER BY doc_id) - 1)::DOUBLE / count(*) OVER (PARTITION BY q, rs) AS sem FROM r),
        words AS (SELECT q, doc_id, p, unnest(list_distinct(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM k),
        refs AS (SELECT DISTINCT w.q, w.doc_id AS a, k.doc_id AS b FROM words w JOIN k ON k.q = w.q AND w.w = 'file_' || k.doc_id % 4 AND k.p <> w.p),
        rel AS (SELECT q, a, count(DISTINCT b) AS n FROM (SELECT q, a, b FROM refs UNION SELECT q, b, a FROM refs) GROUP BY ALL)
        SELECT k.q AS query_id, doc_id AS chunk_key, round(0.65::DOUBLE * sem + 0.25::DOUBLE * len(list_filter(['the', 'of', 'password', 'status'], lambda x: list_contains({_SIMPLE.format("(p || '   ' || c)")}, x))) / 4 + 0.10::DOUBLE * least(coalesce(n, 0) / 2.0::DOUBLE, 1), 6) AS bug_score, coalesce(n, 0) AS related
        FROM k LEFT JOIN rel ON rel.q = k.q AND rel.a = k.doc_id""",
    "join_bug_refs": f"""WITH r AS (SELECT source AS q, doc_id, lower(regexp_extract(text, '([a-z]{{6,}})', 1)) AS s, text AS c FROM documents),
        al AS (SELECT q, doc_id AS b, unnest(list_distinct(list_filter([s, CASE WHEN length('doc' || doc_id) > 4 THEN 'doc' || doc_id END], lambda x: x IS NOT NULL AND length(x) > 3))) AS w FROM r),
        words AS (SELECT q, doc_id AS a, unnest(list_distinct(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM r),
        refs AS (SELECT DISTINCT q, a, b FROM words JOIN al USING (q, w) WHERE a <> b)
        SELECT q AS query_id, a AS chunk_key, count(*) AS related FROM (SELECT q, a, b FROM refs UNION SELECT q, b, a FROM refs) GROUP BY ALL""",
}
