"""Queries over single rows: paths, hashes, query understanding, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.functions import hashing as H
from quarryloom.functions import text as X
from quarryloom.plans import fixtures as fx
from quarryloom.sources.tables import spread, table

joined = lambda c: F.array_join(c, "|")


def prj_language(spark, sf):
    return fx.files(spark, sf).select("doc_id", X.language_of(F.col("file_path")).alias("language"))


def flt_source_files(spark, sf):
    f = fx.files(spark, sf)
    return f.where(X.is_source_file(F.col("file_path"))).select("doc_id", "file_path")


def prj_norm_language(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.chunk_language(F.element_at(F.array(*[F.lit(v) for v in (" PY", ".tsx", "C++", "go", ".md", "..x", "cobol")]), (F.col("doc_id") % 7 + 1).cast("int"))).alias("language"))


def prj_collection_name(spark, sf):
    return fx.repos(spark, sf).select("repo_id", X.collection_name(F.concat(F.lit(" "), F.regexp_replace("repo_url", "https://github.com/", ""))).alias("collection"))


def prj_source_to_collection(spark, sf):
    r = fx.repos(spark, sf)
    kind = F.when(F.col("repo_id") % 3 == 0, "git").when(F.col("repo_id") % 3 == 1, "zip").otherwise("svn")
    place = F.when(F.col("repo_id") % 3 == 0, F.col("repo_url")).otherwise(F.concat(F.lit("/tmp/Up-Load."), F.col("repo_id").cast("string"), F.when(F.col("repo_id") % 2 == 0, ".zip").otherwise(".ZIP")))
    return r.select("repo_id", X.source_collection(kind, place).alias("collection"))


def prj_github_url(spark, sf):
    return fx.repos(spark, sf).select("repo_id", X.github_parts(F.col("repo_url")).alias("p")).select("repo_id", "p.owner", "p.name")


def fn_sha256(spark, sf):
    return table(spark, sf, "documents").select("doc_id", H.sha256(F.col("text")).alias("sha"))


def fn_point_id(spark, sf):
    f = fx.files(spark, sf)
    return f.select("doc_id", H.point_id(F.col("repo_id"), F.col("file_path"), H.sha256(F.col("content"))).alias("point_id"))


def src_zip_fingerprint(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.archive_commit(F.col("html")).alias("commit_id"))


def fn_count_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def fn_keywords(spark, sf):
    return fx.queries(spark, sf).select("query_id", joined(X.keywords(F.col("query"))).alias("keywords"))


def fn_identifiers(spark, sf):
    return fx.queries(spark, sf).select("query_id", joined(X.identifiers(F.col("query"))).alias("identifiers"))


def fn_file_paths(spark, sf):
    return fx.queries(spark, sf).select("query_id", joined(X.file_paths(F.col("query"))).alias("paths"))


def fn_repo_hint(spark, sf):
    return fx.queries(spark, sf).select("query_id", X.repository_hint(F.col("query")).alias("hint"))


def fn_language_hint(spark, sf):
    return fx.queries(spark, sf).select("query_id", X.language_hint(F.col("query")).alias("language"))


def fn_intent_fallback(spark, sf):
    return fx.queries(spark, sf).select("query_id", X.intent(F.col("query")).alias("intent"))


def fn_tokenize_code(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.code_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.sort_array("t"), " ")).alias("digest"))


def fn_tokenize_simple(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.simple_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def fn_build_terms(spark, sf):
    return fx.queries(spark, sf).select("query_id", joined(X.search_terms(F.col("query"))).alias("terms"))


def fn_bug_signals(spark, sf):
    s = fx.queries(spark, sf).select("query_id", X.bug_signals(F.col("query")).alias("s"))
    return s.select("query_id", *[joined(F.col(f"s.{k}")).alias(k) for k in ("entities", "fields", "actions", "errors")])


def flt_is_vuln_query(spark, sf):
    return fx.queries(spark, sf).where(X.is_vulnerability_query(F.col("query"))).select("query_id")


def flt_request(spark, sf):
    q = fx.queries(spark, sf)
    source = F.when(F.col("query_id") % 9 != 0, F.lit("git"))
    return q.select("query_id", F.when(source.isNull(), "missing source").when(F.trim("query") == "", "blank query").when(F.length(F.trim("query")) > 10000, "query too long").alias("early_exit"))


def fn_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.truncated(F.col("text"), 1500)).alias("digest"))


def prj_split_camel(spark, sf):
    split = F.lower(F.translate(F.regexp_replace("name", "(?<!^)(?=[A-Z])", " "), "_-", "  "))
    return fx.queries(spark, sf).select("query_id", F.explode(X.identifiers(F.col("query"))).alias("name")).select("query_id", "name", split.alias("words"))


def prj_hmac(spark, sf):
    d = fx.deliveries(spark, sf).where("delivery_id % 7 != 0")
    return d.select("delivery_id", H.hmac_sha256(b"a shared secret", F.col("payload")).alias("signature"))


def fn_contains_word(spark, sf):
    q = table(spark, sf, "documents")
    return q.where(X.contains_word(F.col("text"), F.lit("tion"))).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        prj_language, flt_source_files, prj_norm_language, prj_collection_name, prj_source_to_collection, prj_github_url, fn_sha256, fn_point_id, src_zip_fingerprint, fn_count_tokens,
        fn_keywords, fn_identifiers, fn_file_paths, fn_repo_hint, fn_language_hint, fn_intent_fallback, fn_tokenize_code, fn_tokenize_simple, fn_build_terms, fn_bug_signals,
        flt_is_vuln_query, flt_request, fn_truncate, prj_split_camel, prj_hmac, fn_contains_word,
    )
}

_quoted = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_case = lambda table, key: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
_LANG = _case(X.EXTENSION_LANGUAGE, r"lower(regexp_extract(file_path, '[^/.][^/]*\.([^./]+)$', 1))")
_NAMES = r"list_filter(regexp_extract_all(query, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*'))"
_DISTINCT = "list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)"


def _words_sql(text: str) -> str:
    r"""Code words in SQL."""
    return rf"list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace({text}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1), lambda w: lower(w))"


def _tokens_sql(w: str) -> str:
    parts = ", ".join(
        f"CASE WHEN coalesce(list_position(list_transform({w}, lambda k: length(k) > 3 AND k <> '{p}' AND contains(k, '{p}')), true), 0) > 0 AND (coalesce(list_position({w}, '{p}'), 0) = 0 OR "
        f"list_position(list_transform({w}, lambda k: length(k) > 3 AND k <> '{p}' AND contains(k, '{p}')), true) < list_position({w}, '{p}')) THEN '{p}' END"
        for p in X.CODE_PARTS
    )
    return f"list_concat({w}, list_filter([{parts}], lambda x: x IS NOT NULL))"


_INTENT = ", ".join(f"CASE WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(p)})($|[^\\p{{L}}\\p{{N}}_])') THEN '{n}' END" for n, p in X.INTENT_PHRASES.items())
_HINTS = ", ".join(f"CASE WHEN regexp_matches(lower(query), '(^|[^a-z0-9+#])({a.replace('+', '[+]')})($|[^a-z0-9+#])') THEN '{n}' END" for a, n in sorted(X.LANGUAGE_HINTS.items(), key=lambda p: -len(p[0])))
_SIMPLE = r"list_transform(regexp_extract_all(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z][A-Za-z0-9]*'), lambda w: lower(w))"
_UUID = """substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12)"""
_HMAC_KEY = b"a shared secret".ljust(64, b"\0")
_pad = lambda p: "unhex('" + bytes(b ^ p for b in _HMAC_KEY).hex() + "')"

ORACLE_SQL = {
    "prj_language": f"WITH {fx.FILES_SQL} SELECT doc_id, {_LANG} AS language FROM files",
    "flt_source_files": f"""WITH {fx.FILES_SQL} SELECT doc_id, file_path FROM files WHERE {_LANG} IS NOT NULL
        AND len(list_filter(string_split(file_path, '/'), lambda p: starts_with(p, '.') OR p IN {_quoted(X.IGNORED_DIRS)})) = 0""",
    "prj_norm_language": f"SELECT doc_id, (['python', 'typescript', 'cpp', 'go', 'markdown', 'x', 'cobol'])[doc_id % 7 + 1] AS language FROM documents",
    "prj_collection_name": f"WITH {fx.REPOS_SQL} SELECT repo_id, translate(lower(trim(replace(repo_url, 'https://github.com/', ''))), '-./:', '____') AS collection FROM repos",
    "prj_source_to_collection": f"""WITH {fx.REPOS_SQL} SELECT repo_id, CASE repo_id % 3
        WHEN 0 THEN 'repo_' || replace(replace(replace(lower(replace(replace(repo_url, 'https://github.com/', ''), '.git', '')), '/', '_'), '-', '_'), '.', '_')
        WHEN 1 THEN 'repo_local_up_load_' || repo_id END AS collection FROM repos""",
    "prj_github_url": f"WITH {fx.REPOS_SQL} SELECT repo_id, string_split(repo_url, '/')[4] AS owner, replace(string_split(repo_url, '/')[5], '.git', '') AS name FROM repos",
    "fn_sha256": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "fn_point_id": f"WITH {fx.FILES_SQL}, hashed AS (SELECT doc_id, sha1(unhex('{H.NAMESPACE}') || encode(repo_id || ':' || file_path || ':' || sha256(content))) AS h FROM files) SELECT doc_id, {_UUID} AS point_id FROM hashed",
    "src_zip_fingerprint": "SELECT page_id, 'zip_' || substr(sha256(html), 1, 16) AS commit_id FROM pages",
    "fn_count_tokens": "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS INT) AS tokens FROM documents",
    "fn_keywords": f"WITH {fx.QUERIES_SQL}, n AS (SELECT query_id, list_filter({_NAMES}, lambda w: lower(w) NOT IN {_quoted(X.STOP_WORDS)} AND length(w) >= 2) AS l FROM queries) SELECT query_id, array_to_string({_DISTINCT}[1:10], '|') AS keywords FROM n",
    "fn_identifiers": f"""WITH {fx.QUERIES_SQL}, n AS (SELECT query_id, list_filter({_NAMES}, lambda w: regexp_matches(w, '[a-z][A-Z]') OR (contains(w, '_') AND NOT starts_with(w, '_')) OR (regexp_matches(w, '[A-Za-z]')
        AND regexp_matches(w, '[0-9]')) OR regexp_full_match(w, '[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+')) AS l FROM queries) SELECT query_id, array_to_string({_DISTINCT}[1:10], '|') AS identifiers FROM n""",
    "fn_file_paths": rf"""WITH {fx.QUERIES_SQL}, pieces AS (SELECT query_id, regexp_extract_all(query, '[\p{{L}}\p{{N}}_./\-]+') AS l0 FROM queries),
        n AS (SELECT query_id, list_filter(l0, lambda w: regexp_full_match(lower(w), '(?:[a-z0-9_.\-]+/)*[a-z0-9_.\-]+\.(?:{'|'.join(X.PATH_EXTENSIONS)})')) AS l FROM pieces)
        SELECT query_id, array_to_string({_DISTINCT}[1:10], '|') AS paths FROM n""",
    "fn_repo_hint": rf"""WITH {fx.QUERIES_SQL} SELECT query_id, CASE WHEN query LIKE '%repo acme/tools%' THEN 'acme/tools' WHEN query LIKE '%repository: demo-1.core%' THEN 'demo-1.core' END AS hint FROM queries""",
    "fn_language_hint": f"WITH {fx.QUERIES_SQL} SELECT query_id, coalesce({_HINTS}) AS language FROM queries",
    "fn_intent_fallback": rf"""WITH {fx.QUERIES_SQL}, lowered AS (SELECT query_id, lower(trim(query)) AS q FROM queries), f AS (SELECT query_id, q, list_filter([{_INTENT}], lambda x: x IS NOT NULL) AS found FROM lowered)
        SELECT query_id, CASE WHEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])({X.SECURITY})($|[^\p{{L}}\p{{N}}_])') THEN 'FIX_VULNERABILITY' WHEN len(found) = 1 THEN found[1] END AS intent FROM f""",
    "fn_tokenize_code": f"WITH w AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents), t AS (SELECT doc_id, {_tokens_sql('w')} AS t FROM w) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM t",
    "fn_tokenize_simple": f"WITH t AS (SELECT doc_id, {_SIMPLE.format('text')} AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t",
    "fn_build_terms": f"""WITH {fx.QUERIES_SQL}, ids AS (SELECT query_id, query, list_filter({_NAMES}, lambda w: regexp_matches(w, '[a-z][A-Z]') OR (contains(w, '_') AND NOT starts_with(w, '_')) OR (regexp_matches(w, '[A-Za-z]')
        AND regexp_matches(w, '[0-9]')) OR regexp_full_match(w, '[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+')) AS l FROM queries),
        kws AS (SELECT query_id, query, {_DISTINCT}[1:10] AS ids, list_filter({_NAMES}, lambda w: lower(w) NOT IN {_quoted(X.STOP_WORDS)} AND length(w) >= 2) AS k FROM ids),
        texts AS (SELECT query_id, unnest(list_concat(ids, {_DISTINCT.replace('(l,', '(k,').replace('(l ', '(k ').replace('transform(l,', 'transform(k,')}[1:10], [query])) AS x, generate_subscripts(list_concat(ids, {_DISTINCT.replace('(l,', '(k,').replace('transform(l,', 'transform(k,')}[1:10], [query]), 1) AS nth FROM kws),
        words AS (SELECT query_id, nth, {_words_sql('x')} AS w FROM texts),
        tokens AS (SELECT query_id, nth, unnest({_tokens_sql('w')}) AS t, generate_subscripts({_tokens_sql('w')}, 1) AS i FROM words),
        firsts AS (SELECT query_id, t, min(nth * 100000 + i) AS pos FROM tokens GROUP BY query_id, t),
        ranked AS (SELECT query_id, t, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM firsts),
        listed AS (SELECT query_id, string_agg(t, '|' ORDER BY pos) AS terms FROM ranked WHERE r <= 12 GROUP BY query_id)
        SELECT q.query_id, coalesce(terms, '') AS terms FROM queries q LEFT JOIN listed USING (query_id)""",
    "fn_bug_signals": f"""WITH {fx.QUERIES_SQL}, t AS (SELECT query_id, {_SIMPLE.format('query')} AS t FROM queries), d AS (SELECT query_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM t)
        SELECT query_id, array_to_string(list_filter(t, lambda x: x NOT IN {_quoted((*X.BUG_STOP_WORDS, *X.BUG_ACTIONS, *X.BUG_ERRORS, *X.BUG_FIELDS))} AND length(x) > 2), '|') AS entities,
        array_to_string(list_filter(t, lambda x: x IN {_quoted(X.BUG_FIELDS)}), '|') AS fields, array_to_string(list_filter(t, lambda x: x IN {_quoted(X.BUG_ACTIONS)}), '|') AS actions,
        array_to_string(list_filter(t, lambda x: x IN {_quoted(X.BUG_ERRORS)}), '|') AS errors FROM d""",
    "flt_is_vuln_query": f"""WITH {fx.QUERIES_SQL} SELECT query_id FROM (SELECT query_id, lower(query) AS q FROM queries) WHERE contains(q, 'package.json') OR contains(q, 'vulnerab') OR contains(q, 'audit')
        OR (contains(q, 'package') AND (contains(q, 'fix') OR contains(q, 'update') OR contains(q, 'patch')))""",
    "flt_request": f"WITH {fx.QUERIES_SQL} SELECT query_id, CASE WHEN query_id % 9 = 0 THEN 'missing source' WHEN trim(query) = '' THEN 'blank query' WHEN length(trim(query)) > 10000 THEN 'query too long' END AS early_exit FROM queries",
    "fn_truncate": "SELECT doc_id, md5(CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || chr(10) || '... [truncated]' ELSE text END) AS digest FROM documents",
    "prj_split_camel": f"""WITH {fx.QUERIES_SQL}, n AS (SELECT query_id, list_filter({_NAMES}, lambda w: regexp_matches(w, '[a-z][A-Z]') OR (contains(w, '_') AND NOT starts_with(w, '_')) OR (regexp_matches(w, '[A-Za-z]')
        AND regexp_matches(w, '[0-9]')) OR regexp_full_match(w, '[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+')) AS l FROM queries), e AS (SELECT query_id, unnest({_DISTINCT}[1:10]) AS name FROM n)
        SELECT query_id, name, lower(translate(substr(name, 1, 1) || regexp_replace(substr(name, 2), '([A-Z])', ' \\1', 'g'), '_-', '  ')) AS words FROM e""",
    "prj_hmac": f"WITH {fx.DELIVERIES_SQL} SELECT delivery_id, sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(payload)))) AS signature FROM deliveries WHERE delivery_id % 7 <> 0",
    "fn_contains_word": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(tion)($|[^\p{L}\p{N}_])')",
}
