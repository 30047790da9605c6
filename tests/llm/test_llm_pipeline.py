"""The pipeline's stages, each against the operator's brute-force version or its own decisions."""

import importlib

import pytest

from quarryloom.llm import decontaminate, quality, registry, simhash
from quarryloom.llm.common import fold

SF = "/root/testdata/sf0.001"


def firsts(rows):
    """The smallest ids of the components of all pairs whose five-word shingles have a similarity of 4/5 or more."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return {min(d for (d, _), x in zip(rows, label, strict=True) if x == y) for y in set(label)}


def test_stages_keep_columns_and_take_effect(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = pipeline.quality_classifier(spark, docs, SF).cache()
    model = quality.train(docs, labels.where(fold("doc_id", 3) != 1))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.score >= 0.5}
    single = pipeline.simhash_near_dedup(spark, good, SF).cache()
    assert {r.doc_id for r in single.collect()} == firsts([(r.doc_id, r.text) for r in good.collect()]) and single.columns == docs.columns
    clean = pipeline.benchmark_decontamination(spark, single, SF).cache()
    hit = {r.doc_id for r in decontaminate.find_contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.hits}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit
    masked = pipeline.secret_scans(spark, clean, SF).cache()
    assert masked.columns == docs.columns and masked.count() == clean.count() and all(r.n_chars == len(r.text) for r in masked.collect())
    last = pipeline.sentencepiece_encoding(spark, masked, SF)
    assert last.count() == masked.count() and all(r.round_trip for r in last.collect())
    assert pipeline.run(spark, SF).count() == masked.count()


def test_near_dedup_of_odd_rows(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x y z"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in pipeline.simhash_near_dedup(spark, docs, SF).collect()) == ["1", "3", "None"]


@pytest.mark.parametrize("name", ["op1_warc", "op5_decontaminate", "op6_substrings"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))


def test_one_query_for_each_operator():
    import re

    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))


def test_queries_against_brute_force(spark):
    import hashlib
    import zlib

    from test_llm_operators import brute_components, brute_fingerprint, brute_secrets

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op9_simhash"](spark, SF).collect()} == want
    kinds = ("assign", "access", "hex")
    for r in registry.QUERIES["op2_secrets"](spark, SF).collect():
        spans = brute_secrets(dict(docs)[r.doc_id])
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(listed.encode()).hexdigest())
    shards = registry.QUERIES["op7_sharding"](spark, SF).collect()
    assert all(r.size == len(dict(docs)[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(dict(docs)[r.doc_id].encode()) for r in shards) and len(shards) == len(docs)
    for s in range(16):
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))


def test_near_dedup_links_all_at_four_fifths(spark):
    """Copies with some words changed, among unrelated texts that share a passage, against all pairs."""
    import random

    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(30, 300))] + passage
        texts.append(base)
        for changed in (1, 2, 4, 6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = word()
            texts.append(copy)
    rng.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in pipeline.simhash_near_dedup(spark, docs, SF).collect()}
    assert got == set(root)
    assert got != {r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_near_dedup_keeps_a_row_of_every_component(spark):
    """Different texts without an id, and under a repeated one, each stay; of a repeated id the copy of another goes."""
    pipeline = importlib.import_module("corpus_pipeline")
    rows = [(1, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q r"), (None, "m n o p q r"), (7, "a b c d e f"), (7, "s t u v w x"), (7, "y z a a b b")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text) for r in pipeline.simhash_near_dedup(spark, docs, SF).collect())
    assert got == [("1", "a b c d e f"), ("7", "s t u v w x"), ("7", "y z a a b b"), ("None", "g h i j k l"), ("None", "m n o p q r")]


@pytest.mark.parametrize(("hot", "cell"), [(32, 1024), (3, 4)])
def test_near_dedup_by_groups_and_cells(spark, hot, cell):
    """A group of changed copies, of which many are similar to others only through a third, shared passages, ties, repeated rows and odd ones."""
    import random

    r = random.Random(11)
    word = lambda: r.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + r.choice("0123456789")
    base = [word() for _ in range(90)]
    rows = [(k, " ".join(w if r.random() > r.choice([0.0, 0.01, 0.03, 0.06]) else word() for w in base)) for k in range(60)]
    passage = " ".join(word() for _ in range(12))
    rows += [(100 + k, passage + " " + " ".join(word() for _ in range(r.choice([3, 20, 60])))) for k in range(20)]
    rows += [(200, " ".join(base[:60])), (201, " ".join(base[:62])), (202, rows[0][1]), (202, rows[0][1]), (203, None), (204, ""), (205, "one two"), (206, "ONE two ")]
    found = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot, cell=cell).collect()
    by_root = {}
    for x in found:
        by_root.setdefault(x.root, []).append(x.doc_id)
    assert len(found) == len(rows) and {min(v) for v in by_root.values()} == firsts(rows)


def test_texts_that_are_not_looked_for_do_not_move(spark):
    docs = spark.range(4000).selectExpr("md5(cast(id AS string)) AS mark", "id")
    wanted = docs.where("id % 40 = 0").select("mark")
    found = {r.id for r in simhash.named_rows(docs, wanted, "mark").collect()}
    assert {*range(0, 4000, 40)} <= found and len(found) < 1000
    assert simhash.named_rows(docs, wanted.limit(0), "mark").count() == 0


def test_sketches_never_pass_over_a_similar_pair():
    import numpy as np

    r = np.random.default_rng(3)
    for n in (1, 10, 3000, 20000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.append(x[n // 9 :], r.integers(0, 1 << 63, n // 20).astype(np.uint64)))
        assert np.bitwise_count(simhash.odd_sketch(x) ^ simhash.odd_sketch(y)).sum() <= len(np.setxor1d(x, y))
        assert simhash.united([x, y, x], np.array([1, 2, 1]), np.zeros(3)) == ([(0, 1)] if 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y)) else [])
