"""Small cases of what a review found, each of which failed before it was mended."""

import io
import json
import random
import re
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quarryloom.api import Engine, run_search
from quarryloom.functions import text as X
from quarryloom.operators import audit, code, search
from quarryloom.operators.embedding import embed
from quarryloom.sources import files


def test_a_manifest_is_json_only_as_a_whole(spark):
    texts = ['{"a": 1}', " [1, 2]\n ", "null", "1 2", '{"a": 1} x', '{"a":1}{"b":2}', "[1] ]", "1, 2", '1, "b": 2', '"x" y', "", "  ", "[1] // c", "12\nthen prose\nand more\nlines"]

    def whole(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    chunks = spark.createDataFrame([(i, 1, 0, t) for i, t in enumerate(texts)], "file_path int, start_line int, ord int, content string")
    got = {r.file_path: r.is_json for r in audit.rebuild(chunks).collect()}
    assert [got[i] for i in range(len(texts))] == [whole(t) for t in texts]
    assert [got[i] for i in range(len(texts))].count(True) == 3


def archive(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def test_an_archive_of_files_that_are_all_too_large_is_not_empty(spark, tmp_path):
    large, mixed, none = archive(("a.py", "x" * 50)), archive(("a.py", "x" * 50), ("b.py", "x")), archive()
    rows = spark.createDataFrame([("large", large), ("mixed", mixed), ("none", none)], "archive string, content binary")
    got = [(r.archive, r.file_path, r.error) for r in files.archive_members(rows, most_file_bytes=40).orderBy("archive").collect()]
    assert got == [("mixed", "b.py", None), ("none", None, "the archive holds no file")]
    # a job of such an archive still says why it changed nothing
    engine = Engine(spark, f"file://{tmp_path}/store")
    engine.register(spark.createDataFrame([("https://github.com/a/b",)], "repo_url string"))
    owned = engine.repositories().select("repo_id", F.lit(large).alias("content"))
    engine.ingest_archives(owned, job_id="j", most_file_bytes=40)
    job = engine.jobs().first()
    assert job.status == "failed" and "too large" in job.error


def test_unique_terms_keep_digits_that_are_their_place(spark):
    rows = spark.createDataFrame([(["zero0", " one1 ", "ZERO0", "", "3three", "4four", None],)], "v array<string>")
    assert rows.select(X.unique_terms(F.col("v")).alias("u"), X.unique_terms(F.col("v"), 2).alias("two"), X.unique_terms(F.lit(None).cast("array<string>")).alias("none")).first() == (["zero0", "one1", "3three", "4four"], ["zero0", "one1"], None)


def test_related_rows_are_counted_without_pairs(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "file_a", "file_b", "abc", "long_name"]
    rows = [(q, i, rng.choice([None, "src/file_a.py", "lib/file_b.py", "lib/File_A.ts", f"x/own{i}.py"]), rng.choice([None, "", "Alpha", "beta", "abc", "file_b", "unseen"]), " ".join(rng.sample(words, rng.randrange(5)) + [f"own{rng.randrange(40)}"])) for q in (1, 2) for i in range(40)]
    want = {}

    def aliases(r):
        stem = r[2].rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
        return {a for a in ((r[3] or "").lower(), stem if len(stem) > 4 else "") if len(a) > 3}

    for a in rows:
        other = [b for b in rows if b[0] == a[0] and b[2] and a[2] and b[2] != a[2]]
        n = sum(bool(aliases(b) & set(a[4].split()) or aliases(a) & set(b[4].split())) for b in other)
        if n:
            want[a[0], a[1]] = n
    df = spark.createDataFrame(rows, "query_id int, chunk_key int, file_path string, symbol string, content string")
    found = search._related(df, "chunk_key")
    assert {(r.query_id, r.chunk_key): r.related for r in found.collect()} == want and max(want.values()) > 10
    # a word that all texts have and all rows are named by makes as many rows as there are texts, not pairs of them
    many = spark.range(3000).select(F.lit(1).alias("query_id"), F.col("id").alias("chunk_key"), F.concat(F.lit("d/own"), F.col("id"), F.lit(".py")).alias("file_path"), F.lit("common").alias("symbol"), F.lit("common words").alias("content"))
    assert {r.related for r in search._related(many, "chunk_key").collect()} == {2999}


def test_tokens_are_taken_in_one_walk_over_the_words(spark):
    """Each added code word is told by its first place alone; before, each was searched for among all words that hold one."""
    rng = random.Random(5)
    pieces = ["getUser", "user", "get", "GET", "reset", "set", "repo", "repository", "repositoryA", "HTTPServer", "a", "B2", "é", "İx", "Key", "x_y", "addressBook", "add", "9", "status2", "-", "..", "SET", "Setup", "preset"]
    texts = ["", None, *[" ".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(300)]]

    def want(text):
        t = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text or ""))
        words = [w.lower() for w in re.split("[^a-zA-Z0-9]+", t) if len(w) > 1]
        first = lambda found: next((i for i, w in enumerate(words) if found(w)), len(words))
        return words + [p for p in X.CODE_PARTS if first(lambda w: len(w) > 3 and w != p and p in w) < first(lambda w: w == p)]  # noqa: B023

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", X.code_tokens(F.col("text")).alias("t"))
    assert [list(r.t) for r in rows.orderBy("i").collect()] == [want(t) for t in texts]
    # no search for a code word among the words, and no blank put in for every mark between two of them
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "array_position" not in plan and "[^a-zA-Z0-9]" not in plan


def test_plain_statements_are_read_without_a_tree_of_each():
    """Runs of plain lines are one number in what is parsed; whatever can make lines belong together is parsed as it is."""
    plain = "class A(Base):\n    x: int\n    y = Column(Integer)\n    x: str\n    z: str = 'a'\n    @property\n    def label(self):\n        return self.name\n\nx = fields.Str(required=True, attribute=\"f\")\n" + "print(x.y)\n" * 50
    want = [("A", "x", "field", 2), ("A", "y", "column", 3), ("A", "z", "field", 5), ("A", "label", "property", 7)]
    assert code.class_members(plain) == want
    tree, runs = code._parsed(plain)
    assert len(tree.body) == 2 and sorted(runs) == [2, 10] and runs[10].count("print") == 50
    for woven in ("k = [\n", 'k = """\n', "k = (\n", "k = 'a\n", "k = f'{'\n", "k = 1 \\\n", "k = f(b=1, a)\n", "k = {  # }\n"):
        source = woven + plain
        try:
            compile(source, "x", "exec", code.ast.PyCF_ONLY_AST)
        except SyntaxError:
            assert code.class_members(source) == code._loose_members(source)
    closed = "k = [\n" + "x,\n" * 3 + "]\nclass B:\n    a: int\n    b = (\n        c\n    )\n"
    assert code.class_members(closed) == [("B", "a", "field", 7), ("B", "b", "column", 8)]


def test_a_contract_counts_targets_without_gathering_them(spark):
    model = "class M:\n    a: int\n    total: int\n    def run(self): pass\n"
    use = lambda t: f'u = fields.Str(attribute="{t}")\n'
    cases = {"NONE": (model, use("a") + "p.total\n"), "FIELD_MAPPING_MISMATCH": (model, use("a") + use("run")), "INSUFFICIENT": (model, ""), "AMBIGUOUS": (model + "class m:\n    b: int\n", use("a")), "WRONG_FIELD_REFERENCE": (model.replace("total", "total_sum"), "p.total\n"), "MODEL_FIELD_MISSING": ("class M:\n    b: int\n    def run(self): pass\n", "p.total\n")}
    for want, (m, u) in cases.items():
        chunks = spark.createDataFrame([("m", m), ("u", u), ("other", "class Other:\n    q: int\n"), ("k", "class \uff2d2:\n    q: int\n")], "key string, content string")
        models, refs = (code.class_models(chunks, key="key", named="M"), code.schema_references(chunks, key="key", field="total"))
        out = code.contract(models, refs, key="key", class_name="M", field="total")
        assert out.first().issue == want
        assert "collect_set" not in out._jdf.queryExecution().analyzed().toString()
    assert {r.class_name for r in code.class_models(chunks, key="key", named="m").collect()} >= {"M", "M2"}


def test_the_best_of_each_value_are_found_without_copies_of_queries(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)] if i % 17 else None, rng.choice([None, 1, 2, 3])) for i in range(400)]
    e = spark.createDataFrame(rows, "i int, v array<double>, label int").repartition(3)
    q = e.where("i % 50 = 3").select(F.col("i").alias("q"), F.col("v").alias("qv"))
    got = search.dense_topk(e, q, point_id="i", vector="v", query_id="q", query_vector="qv", k=3, each="label")
    vectors = {i: (v, label) for i, v, label in rows if v}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = set()
    for i in (i for i in range(3, 400, 50) if i in vectors):
        for label in (None, 1, 2, 3):
            near = sorted((-round(cos(vectors[i][0], v), 12), j) for j, (v, of) in vectors.items() if of == label)[:3]
            want |= {(i, label, j, r + 1) for r, (_, j) in enumerate(near)}
    assert {(r.query_id, r.label, r.point_id, r.rank) for r in got.collect()} == want


def test_patches_leave_a_task_in_small_parts(spark):
    """However many rows come in a batch, few texts are Python strings at once, so a worker's memory does not grow with the batch."""
    from quarryloom.operators import patches, verify

    rows = spark.range(300, numPartitions=1).select(F.col("id").alias("change_id"), F.lit("m.py").alias("file_path"), F.lit("a\nb\n").alias("source"), F.lit(1).alias("base_line"), F.lit("a").alias("old_code"), F.lit("c").alias("new_code"))
    run = {}
    whole = pa.RecordBatch.from_pylist([r.asDict() for r in rows.collect()])

    class Kept:  # takes the place of a DataFrame and keeps the function that it is given
        schema = {"change_id": type("t", (), {"dataType": type("d", (), {"simpleString": staticmethod(lambda: "long")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            run["f"] = f

    verify.verify_changes(Kept())
    seen = [b.num_rows for b in run["f"](iter([whole]))]
    assert sum(seen) == 300 and max(seen) <= verify.TOGETHER
    found = pa.RecordBatch.from_pylist([{"change_id": i, "source": "a\nb\n", "patches": ["@@ -1 +1 @@\n-a\n+c"]} for i in range(300)])
    patches.apply_patches(Kept(), key="change_id")
    made = list(run["f"](iter([found])))
    assert sum(b.num_rows for b in made) == 300 and max(b.num_rows for b in made) <= verify.TOGETHER
    assert set(made[0].column("text").to_pylist()) == {"c\nb\n"}


def test_sparse_search_moves_no_pairs_of_queries_and_chunks(spark):
    """Each task keeps its best k for each query: all that is moved is what is ranked; repeated keys are one chunk whose counts are added up."""
    rows = [(f"k{i:03}", "fn", None, "alpha beta " + "gamma " * (i % 5)) for i in range(200)] + [("k003", "fn", None, "alpha beta " + "gamma " * 3)]
    c = spark.createDataFrame(rows, "chunk_key string, function_name string, class_name string, content string").repartition(3)
    t = spark.createDataFrame([(q, w) for q in range(7) for w in ("gamma", "alpha", "none")[: 1 + q % 3]], "query_id int, term string")
    found = search.bm25(c, t, k=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    postings, sizes = search.term_statistics(c, key="chunk_key", function="function_name", class_="class_name", code="content")
    df = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    part = search.bm25_part(*map(F.col, ("tf", "length", "df", "n_docs", "average", "weight")))
    pairs = postings.join(df, ["field", "term"]).join(sizes, "field").join(t, "term").groupBy("query_id", "chunk_key").agg(F.round(F.sum(part), 9).alias("score")).collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r.score, r.chunk_key)):
        want.setdefault(r.query_id, []).append((r.chunk_key, r.score))
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.chunk_key, r.score))
    assert got == {q: v[:4] for q, v in want.items()}
    assert any(k == "k003" for k, _ in got[0])


def test_dense_search_keeps_no_more_than_k_of_equal_points():
    import numpy as np
    import pyarrow as pa

    class Block:
        value = (pa.array([1, 2]), None, np.array([[1.0, 0.0], [0.0, 1.0]]))

    batch = pa.RecordBatch.from_arrays([pa.array([f"p{i:05}" for i in reversed(range(3000))]), pa.array([[1.0, 1.0]] * 3000)], ["point_id", "vector"])
    out = pa.Table.from_batches(search._best_of_batch(Block, 5, None)(iter([batch]))).to_pylist()
    assert len(out) == 10
    assert {r["point_id"] for r in out} == {f"p{i:05}" for i in range(5)}


def test_advisories_are_not_sorted_for_their_join(spark):
    """What a task holds are direct dependencies alone, so its memory does not grow with the advisories."""
    audits = spark.range(50).selectExpr("id AS audit_id", """'{"vulnerabilities":{"p":{"severity":"low","via":[{"title":"T","severity":"high"}]},"q":{"via":["p"],"isDirect":true}}}' AS report""")
    direct = spark.range(0, 50, 2).selectExpr("id AS audit_id", "'p' AS package", "'^1' AS version")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = audit.advisories(audits, direct)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Sort " not in plan
        got = {(r.audit_id, r.package): (r.current_version, r.severity, r.is_direct, r.title) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {(i, "p"): ("unknown" if i % 2 else "^1", "high", i % 2 == 0, "T") for i in range(50)} | {(i, "q"): ("unknown", "unknown", True, "q vulnerability") for i in range(50)}


def _indexed(spark, rows):
    return spark.createDataFrame([(str(i), "repo_local_r", p, f"h{i}", a, b, "text", text, name, None) for i, (p, a, b, name, text) in enumerate(rows)], "point_id string, collection string, file_path string, chunk_hash string, start_line int, end_line int, language string, content string, function_name string, class_name string")


def test_each_stage_of_a_search_decides_what_follows(spark):
    rows = [("src/app.py", 1, 9, "save_user", "def save_user(user): store the user " + "x" * 3000), ("src/app.py", 1, 10, "save_user_again", "def save_user_again(user): store the user " + "y" * 3000)]
    rows += [(f"src/m{i}.py", 1, 5, f"step_{i}", f"def step_{i}(user): the user is saved by step {i} " + "z" * 900) for i in range(9)]
    rows += [("web/package-lock.json", 1, 5, None, '{"lock": 1}'), ("web/package.json", 7, 9, None, '{"b": 1}'), ("web/package.json", 1, 6, None, '{"a": 1}')]
    points = embed(_indexed(spark, rows))
    asked = ["fix the bug in save_user of src/app.py", "find save_user in src/app.py", "npm audit says a vulnerability, fix it", "find save_user in src/app.py", "find step_1 in src/m1.py"]
    queries = spark.createDataFrame([(i, q, "zip", "/x/r.zip") for i, q in enumerate(asked)], "query_id long, query string, source_type string, source_location string")

    def analyse(df):
        files = F.when(F.col("query_id") == 3, F.array(F.lit("a.py"), F.lit("b.py"), F.lit("c.py"))).otherwise(F.array(F.lit("a.py"), F.lit("src/app.py")))
        return df.where("query_id != 2").select("query_id", F.when(F.col("query_id") == 4, "UNAVAILABLE").otherwise("AVAILABLE").alias("analysis_status"), F.lit("do this").alias("proposal"), F.col("context").substr(1, 0).alias("text"), files.alias("files"))

    # of its own files the third has two unknown ones left after two rounds, as a round names one fewer
    got = {r.query_id: r for r in run_search(queries, points, analyse=analyse, again=lambda df: df.withColumn("files", F.when(F.size("files") > 1, F.slice("files", 2, 9)).otherwise(F.col("files")))).collect()}
    # the intent gives room to the context, and the larger of overlapping chunks is there once
    assert got[0].intent == "FIX_BUG" and got[0].context.count(" CODE ") > got[1].context.count(" CODE ") and "x" * 1600 not in got[1].context and "y" * 1400 in got[1].context
    assert "src/app.py:1-9\n" not in got[0].context and "src/app.py:1-10\n" in got[0].context
    # a query about packages sees manifests, package files first
    assert (got[2].results, got[2].top_file) == (3, "web/package.json") and "src/" not in got[2].context and got[2].context.index('{"a": 1}') < got[2].context.index('{"b": 1}') < got[2].context.index('{"lock": 1}')
    # what validation says is kept
    assert (got[0].validation, got[0].confidence, got[0].early_exit) == ("passed", "high", None) and got[1].confidence == "high"
    assert (got[3].validation, got[3].confidence, got[3].early_exit) == ("failed", "low", "EARLY_EXIT_D")
    assert [(got[i].validation, got[i].confidence) for i in (2, 4)] == [("unavailable", "low")] * 2


def test_after_one_batch_a_query_is_met_by_what_can_still_be_among_its_best(monkeypatch):
    import numpy as np

    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    share = np.where(np.arange(60) < 20, 0.5, 0.01)
    has = r.random((5000, 60)) < share
    tf, length = r.integers(1, 5, has.shape), r.integers(20, 200, 5000)
    entries = [[{"field": "code", "term": words[w], "tf": int(tf[i, w]), "length": int(length[i])} for w in np.flatnonzero(has[i])] for i in range(5000)]
    chunks = pa.RecordBatch.from_pydict({"on": ["a"] * 5000, "point_id": [f"c{i:05}" for i in r.permutation(5000)], "entries": entries})
    queries = [sorted({*r.choice(20, r.integers(0, 5), replace=False), *r.choice(np.arange(20, 60), r.integers(0, 3), replace=False)}) for _ in range(700)]
    queries = [q or [0] for q in queries]
    asked = pa.table({"on": ["a"] * 700, "query_id": list(range(700)), "terms": [[words[w] for w in q] + ["none"] for q in queries]})
    df = has.sum(0)
    facts = pa.table({"on": ["a"] * 60, "field": ["code"] * 60, "term": words, "df": df, "n_docs": [5000.0] * 60, "average": [float(length.mean())] * 60, "weight": [1.0] * 60})

    class Block:
        value = search._block(asked, facts)

    met = []
    add = search._Best.add
    monkeypatch.setattr(search._Best, "add", lambda self, q, s, p, at, digits: (met.append(len(at)), add(self, q, s, p, at, digits))[1])
    out = pa.Table.from_batches(search._best_by_terms(Block, 4, "chunk_key")(iter([chunks]))).to_pylist()
    weight = np.log(1 + (5000 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length[:, None] / length.mean())) * has
    names, got = chunks.column("point_id").to_pylist(), {}
    for x in out:
        got.setdefault(x["query_id"], []).append((-x["score"], x["chunk_key"]))
    for k, q in enumerate(queries):
        scores = np.round(weight[:, q].sum(1), 9)
        want = sorted((-scores[i], names[i]) for i in np.flatnonzero(scores > 0))[:4]
        have = sorted(got.get(k, []))
        assert [p for _, p in have] == [p for _, p in want] and np.allclose([s for s, _ in have], [s for s, _ in want], atol=2e-9)
    # of 3.5 million pairs, most of which share a word, few are kept
    assert sum(met) < 200_000
    best = search._Best(3, 2)
    best.offer(r.random((1000, 2)), pa.array([f"p{i}" for i in range(1000)]), 0, 9)
    assert (best.least > 0.9).all()


def test_words_of_a_batch_are_counted_as_those_of_each_text():
    import hashlib

    import numpy as np
    from quarryloom.operators import embedding

    texts = ["Get user, get USER 2 names", "", "?!", "x" * 9] * 300 + ["last one"]
    out = embedding.hashed_words(texts, 16)
    for text, got in list(zip(texts, out, strict=True))[-6:]:
        want = np.zeros(16)
        for word in re.findall("[a-z0-9]+", text.lower()):
            h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            want[h % 16] += 1 if (h // 16) % 2 else -1
        assert np.allclose(got, want / (np.linalg.norm(want) or 1)) and out.shape == (1201, 16)
    assert embedding.hashed_words([]).shape == (0, 64)
