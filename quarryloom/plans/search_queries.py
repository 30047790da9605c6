"""Queries that retrieve: dense, sparse, fused."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryloom.functions import text as X
from quarryloom.operators import search as S
from quarryloom.operators.chunking import chunk_files, text_chunks
from quarryloom.operators.embedding import embed
from quarryloom.plans import fixtures as fx
from quarryloom.plans.text_queries import ORACLE_SQL as TEXT_SQL
from quarryloom.plans.text_queries import _tokens_sql, _words_sql
from quarryloom.sources.staging import stored
from quarryloom.sources.tables import spread, table


def tf_chunk_text(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(text_chunks(F.col("text"))).alias("ord", "c"))
    return d.select("doc_id", "ord", "c.start_line", "c.end_line", F.md5("c.content").alias("digest"))


def topk_dense(spark, sf):
    """Every twentieth vector as a query against all."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return S.dense_topk(e, q, point_id="vec_id", vector="embedding", query_id="q", query_vector="qv", k=20).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")


def flt_dense_payload(spark, sf):
    """The same, within the query's label and over a threshold."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), "label")
    return S.dense_topk(e, q, point_id="vec_id", vector="embedding", query_id="q", query_vector="qv", k=5, on="label", threshold=0.1).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")


def topk_global(spark, sf):
    """For every twentieth vector each label's best five, concatenated and cut at twenty."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    best = S.dense_topk(e, q, point_id="vec_id", vector="embedding", query_id="q", query_vector="qv", k=5, each="label")
    found = best.select("query_id", "label", F.col("point_id").alias("vec_id"), F.round("score", 6).alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where("rank <= 20")


def score_cosine(spark, sf):
    """The cosine of every vector and its part's representative, the smallest id of its label."""
    e = table(spark, sf, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qv"))
    return e.join(q, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("qv")), 6).alias("score"))


def _corpus(spark, sf, *more):
    """Chunks as an index: key, hash, names and content, and more of the chunks' columns."""
    c = chunk_files(fx.files(spark, sf))
    return c.select(
        F.concat_ws("#", "file_path", "chunk_ord").alias("chunk_key"), "chunk_hash", "file_path", "repo_id", F.regexp_extract("content", "([A-Za-z]{4,})", 1).alias("function_name"),
        F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), F.lit("Service")).alias("class_name"), "content", *more,
    )


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("find getUserName "), "text").alias("query"))


def agg_df(spark, sf):
    d = spread(table(spark, sf, "documents").select("text")).select(F.explode(F.array_distinct(X.code_words(F.col("text")))).alias("term"))
    return d.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def agg_avg_len(spark, sf):
    return spread(table(spark, sf, "documents").select("text")).agg(F.round(F.greatest(F.avg(F.size(X.code_tokens(F.col("text")))), F.lit(1.0)), 6).alias("average"))


def topk_sparse(spark, sf):
    terms = _items(spark, sf).select("query_id", F.explode(X.search_terms(F.col("query"))).alias("term"))
    return S.bm25(_corpus(spark, sf), terms).select("query_id", "chunk_key", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


def tf_embed(spark, sf):
    d = embed(spread(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))))
    return d.select("doc_id", F.posexplode("vector").alias("i", "v")).select("doc_id", "i", F.round("v", 6).alias("v"))


def hybrid_search(spark, sf):
    """Every benchmark item as a query over the chunks of all documents."""
    chunks = stored(_corpus(spark, sf))  # for the three plans that read it
    queries = embed(_items(spark, sf), text_column="query", vector_column="query_vector")
    return S.hybrid(chunks, queries, points=embed(chunks.select("chunk_key", "content")))


def join_rrf(spark, sf):
    """Two rankings of parts (by price and by size) fused for each brand."""
    from pyspark.sql import Window

    p = table(spark, sf, "part")
    ranked = lambda col: p.select(F.col("p_brand").alias("query_id"), "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc(col), "p_partkey")).alias("rank")).where("rank <= 20")
    return S.rrf([ranked("p_retailprice"), ranked("p_size")], key="p_partkey").select("query_id", "p_partkey", F.round("rrf", 9).alias("rrf"), F.col("rank").cast("int").alias("rank"))


def score_rerank(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    ids, kws = F.array(F.lit("the"), F.lit("password")), F.array(F.lit("license"), F.lit("de"), F.lit("la"))
    t = F.lower("text")
    return d.select("doc_id", F.round(0.016 + S.IDENTIFIER_BOOST * S.matched_share(t, ids) + S.KEYWORD_BOOST * S.matched_share(t, kws), 6).alias("score"))


QUERIES = {f.__name__: f for f in (tf_chunk_text, topk_dense, flt_dense_payload, topk_global, score_cosine, agg_df, agg_avg_len, topk_sparse, tf_embed, hybrid_search, join_rrf, score_rerank)}

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_WORD = lambda w: rf"CAST(regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({w})($|[^\p{{L}}\p{{N}}_])') AS INT)"
CHUNKS_SQL = """lines AS (SELECT doc_id, list_filter(list_concat(list_transform(string_split(text, chr(10))[1:-2], lambda x: x || chr(10)), [string_split(text, chr(10))[-1]]), lambda x: x <> '') AS arr FROM documents),
folded AS (
  SELECT doc_id, 0 AS i, CAST([] AS STRUCT(content VARCHAR, s INT, e INT)[]) AS out, CAST([] AS VARCHAR[]) AS cur, 0 AS sz, 1 AS start FROM lines
  UNION ALL
  SELECT doc_id, i,
         CASE WHEN long THEN list_concat(out, list_transform(range(0, 1 + CAST(ceil((length(line) - 1500) / 1350.0) AS INT)), lambda k: {'content': substr(line, k * 1350 + 1, 1500), 's': i, 'e': i})) ELSE out END,
         CASE WHEN long THEN CAST([] AS VARCHAR[]) ELSE list_append(cur, line) END, CASE WHEN long THEN 0 ELSE sz + length(line) END, CASE WHEN long THEN i + 1 ELSE start END
  FROM (
    SELECT doc_id, i, line, length(line) > 1500 AS long, CASE WHEN flush THEN list_append(out, {'content': array_to_string(cur, ''), 's': start, 'e': i - 1}) ELSE out END AS out,
           CASE WHEN flush THEN CASE WHEN keep > 0 THEN cur[len(cur) - keep + 1 :] ELSE CAST([] AS VARCHAR[]) END ELSE cur END AS cur,
           CASE WHEN flush THEN CAST(coalesce(list_sum(list_transform(CASE WHEN keep > 0 THEN cur[len(cur) - keep + 1 :] ELSE [] END, lambda x: length(x))), 0) AS INT) ELSE sz END AS sz,
           CASE WHEN flush THEN i - keep ELSE start END AS start
    FROM (
      SELECT f.doc_id, f.i + 1 AS i, f.out, f.cur, f.sz, f.start, l.arr[f.i + 1] AS line, f.sz + length(l.arr[f.i + 1]) > 1500 AND len(f.cur) > 0 AS flush,
             CAST(len(list_filter(range(1, len(f.cur) + 1), lambda k: coalesce(list_sum(list_transform(f.cur[len(f.cur) - k + 1 :], lambda x: length(x))), 0) <= 150)) AS INT) AS keep
      FROM folded f JOIN lines l ON l.doc_id = f.doc_id WHERE f.i < len(l.arr)))
),
whole AS (SELECT f.doc_id, CASE WHEN len(cur) > 0 THEN list_append(out, {'content': array_to_string(cur, ''), 's': start, 'e': i}) ELSE out END AS out FROM folded f JOIN lines l ON l.doc_id = f.doc_id WHERE f.i = len(l.arr)),
chunked AS (SELECT doc_id, generate_subscripts(out, 1) - 1 AS ord, unnest(out) AS c FROM whole)"""
CORPUS_SQL = f"""{fx.FILES_SQL}, {CHUNKS_SQL},
corpus AS (SELECT file_path || '#' || ord AS chunk_key, sha256(c.content) AS chunk_hash, file_path, repo_id, regexp_extract(c.content, '([A-Za-z]{{4,}})', 1) AS function_name, 'Doc' || doc_id || 'Service' AS class_name, c.content AS content
  FROM chunked JOIN files USING (doc_id) WHERE length(trim(translate(c.content, chr(10) || chr(9) || chr(13), ''))) > 0)"""
ITEMS_SQL = "queries AS (SELECT item_id AS query_id, 'find getUserName ' || text AS query FROM benchmark)"
#: The terms query's steps, over another set of queries.
TERMS_SQL = ITEMS_SQL + TEXT_SQL["fn_build_terms"].removeprefix("WITH " + fx.QUERIES_SQL).rpartition("listed AS")[0] + "terms AS (SELECT query_id, t AS term FROM ranked WHERE r <= 12)"
BM25_SQL = f"""words0 AS (SELECT chunk_key, f.field, {_words_sql('f.body')} AS w FROM (SELECT chunk_key, unnest([{{'field': 'function', 'body': function_name}}, {{'field': 'class', 'body': class_name}}, {{'field': 'code', 'body': substr(content, 1, 12000)}}]) AS f FROM corpus)),
toks AS (SELECT chunk_key, field, {_tokens_sql('w')} AS t FROM words0),
sizes AS (SELECT field, count(*) AS n_docs, greatest(avg(len(t)), 1.0) AS average, CASE field WHEN 'function' THEN 4.0 WHEN 'class' THEN 3.0 ELSE 1.0 END AS weight FROM toks GROUP BY field),
post AS (SELECT chunk_key, field, length, term, count(*) AS tf FROM (SELECT chunk_key, field, len(t) AS length, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
parts AS (SELECT chunk_key, p.term, weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average)) AS part FROM post p JOIN dfs USING (field, term) JOIN sizes USING (field)),
scores AS (SELECT query_id, chunk_key, round(sum(part), 9) AS score FROM parts JOIN terms USING (term) GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank FROM scores WHERE score > 0 QUALIFY rank <= 20)"""


def _embed_sql(name: str, key: str, text: str, source: str) -> str:
    return f"""{name}_h AS (SELECT {key} AS k, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source})),
{name}_s AS (SELECT k, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 1 THEN 1.0 ELSE -1.0 END) AS v FROM {name}_h GROUP BY ALL),
{name}_n AS (SELECT k, sqrt(sum(v * v)) AS n FROM {name}_s GROUP BY k)"""


_BOOST = r"""len(list_filter({0}, lambda t: regexp_matches(body, '(^|[^\p{{L}}\p{{N}}_])(' || lower(t) || ')($|[^\p{{L}}\p{{N}}_])')))"""
ORACLE_SQL = {
    "tf_chunk_text": f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, CAST(ord AS INT) AS ord, c.s AS start_line, c.e AS end_line, md5(c.content) AS digest FROM chunked",
    "topk_dense": f"SELECT q.vec_id AS query_id, e.vec_id AS point_id, round({_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INT) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20",
    "flt_dense_payload": f"SELECT q.vec_id AS query_id, e.vec_id AS point_id, round({_COS}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INT) AS rank FROM embeddings e JOIN embeddings q USING (label) WHERE q.vec_id % 20 = 0 AND {_COS} >= 0.1 QUALIFY rank <= 5",
    "topk_global": f"SELECT query_id, label, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.label, e.vec_id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY {_COS} DESC, e.vec_id) <= 5) QUALIFY rank <= 20",
    "score_cosine": f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) q USING (label)",
    "agg_df": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_words_sql('text')})) AS term FROM documents) GROUP BY term",
    "agg_avg_len": f"SELECT round(greatest(avg(len({_tokens_sql('w')})), 1.0), 6) AS average FROM (SELECT {_words_sql('text')} AS w FROM documents)",
    "topk_sparse": f"WITH RECURSIVE {CORPUS_SQL}, {TERMS_SQL}, {BM25_SQL} SELECT query_id, chunk_key, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM sparse",
    "tf_embed": f"""WITH {_embed_sql('d', 'doc_id', 'text', 'documents')} SELECT doc_id, CAST(i.i AS INT) AS i, round(coalesce(CASE WHEN n > 0 THEN v / n END, 0), 6) AS v FROM documents CROSS JOIN range(0, 64) i(i) LEFT JOIN d_s s ON s.k = doc_id AND s.i = i.i LEFT JOIN d_n n ON n.k = doc_id""",
    "hybrid_search": f"""WITH RECURSIVE {CORPUS_SQL}, {TERMS_SQL}, {BM25_SQL}, {_embed_sql('c', 'chunk_key', 'content', 'corpus')}, {_embed_sql('q', 'query_id', 'query', 'queries')},
        cosines AS (SELECT q.k AS query_id, c.k AS chunk_key, sum(q.v * c.v) AS d FROM q_s q JOIN c_s c USING (i) GROUP BY ALL),
        alls AS (SELECT query_id, chunk_key FROM queries, corpus),
        dense AS (SELECT query_id, chunk_key, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(CASE WHEN qn.n > 0 AND cn.n > 0 THEN d / (qn.n * cn.n) END, 0) DESC, chunk_key) AS rank
          FROM alls LEFT JOIN cosines USING (query_id, chunk_key) LEFT JOIN q_n qn ON qn.k = query_id LEFT JOIN c_n cn ON cn.k = chunk_key QUALIFY rank <= 20),
        both_ AS (SELECT query_id, chunk_key, rank, 0 AS source FROM dense UNION ALL SELECT query_id, chunk_key, rank, 1 FROM sparse),
        fused AS (SELECT query_id, chunk_key, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(source * 1000 + rank) AS first FROM both_ GROUP BY ALL),
        ranked2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first, chunk_key) AS rank FROM fused),
        rowed AS (SELECT r.query_id, r.chunk_key, r.rank, max(rrf) OVER (PARTITION BY query_id, chunk_hash) AS rrf, row_number() OVER (PARTITION BY query_id, chunk_hash ORDER BY rank, chunk_key) AS nth, lower(function_name || ' ' || class_name || ' ' || content) AS body
          FROM ranked2 r JOIN corpus USING (chunk_key)),
        under AS (SELECT query_id, ids, list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i)[1:10] AS kws FROM kws),
        scored AS (SELECT query_id, chunk_key, rank, rrf + CASE WHEN len(ids) > 0 THEN 0.20 * {_BOOST.format('ids')} / len(ids) ELSE 0 END + CASE WHEN len(kws) > 0 THEN 0.05 * {_BOOST.format('kws')} / len(kws) ELSE 0 END AS score
          FROM rowed JOIN under USING (query_id) WHERE nth = 1)
        SELECT query_id, chunk_key, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank, chunk_key) AS INT) AS final_rank FROM scored QUALIFY final_rank <= 20""",
    "join_rrf": """WITH a AS (SELECT p_brand AS query_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 20),
        b AS (SELECT p_brand AS query_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 20),
        f AS (SELECT query_id, p_partkey, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS rrf, coalesce(a.rank, 1000 + b.rank) AS first FROM a FULL JOIN b USING (query_id, p_partkey))
        SELECT query_id, p_partkey, round(rrf, 9) AS rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first, p_partkey) AS INT) AS rank FROM f""",
    "score_rerank": f"SELECT doc_id, round(0.016::DOUBLE + 0.20::DOUBLE * ({_WORD('the')} + {_WORD('password')}) / 2 + 0.05::DOUBLE * ({_WORD('license')} + {_WORD('de')} + {_WORD('la')}) / 3, 6) AS score FROM documents",
}
