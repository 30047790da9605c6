"""Units: text functions, ids, chunkers, evidence scores, code places, sources, streams, and the engine as a whole."""

import hashlib
import hmac
import random
import re
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.api import Engine
from quarryloom.functions import hashing as H
from quarryloom.functions import text as X
from quarryloom.operators import code, embedding, identify, verify
from quarryloom.operators.chunking import text_chunks
from quarryloom.sources import files
from quarryloom.sources.snapshots import Snapshots
from quarryloom.streaming import deliveries


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(("path", "want"), [("a/b.PY", "python"), (".gitignore", None), ("x.tar.gz", None), ("a.b/c", None), ("dir/x.", None), ("Makefile", None), ("d/.eslintrc.json", "json"), ("m.tsx", "typescript"), ("k.h", "c")])
def test_language(spark, path, want):
    assert column(spark, [path], X.language_of) == [want]


def test_source_files(spark):
    paths = ["a/b.py", ".git/x.py", "a/node_modules/x.js", "a/.hid/x.py", "b/dist/x.css", "x.exe", "src/vendor.py"]
    assert column(spark, paths, X.is_source_file) == [True, False, False, False, False, False, True]


def test_source_collections(spark):
    rows = [("git", "https://github.com/Own-er/Re.po.git"), ("git", "http://github.com/a/b"), ("zip", "/tmp/Some-Dir/App.v2.ZIP"), ("git", "https://gitlab.com/a/b"), ("git", "https://github.com/a"), ("zip", "x.tar"), ("svn", "x"), ("git", "ftp://github.com/a/b"), ("git", "https://github.com/a/b/c")]
    df = spark.createDataFrame(rows, "k string, l string").select(X.source_collection(F.col("k"), F.col("l")).alias("c"))
    assert [r.c for r in df.collect()] == ["repo_own_er_re_po", "repo_a_b", "repo_local_app_v2", None, None, None, None, None, None]


def test_intents(spark):
    qs = ["Fix the bug", "find the class", "fix and optimize it", "audit package.json", "hello", "clean up the module", "prefix bugs", "a security   issue here"]
    assert column(spark, qs, X.intent) == ["FIX_BUG", "RETRIEVE", None, "FIX_VULNERABILITY", None, "REFACTOR", None, "FIX_VULNERABILITY"]


def test_names_of_queries(spark):
    assert column(spark, ["getUserName in user_service HTTPServer HttpServer v2 éabc MAX_SIZE _private Plain"], X.identifiers) == [["getUserName", "user_service", "HttpServer", "v2", "MAX_SIZE"]]
    assert column(spark, ["see src/app/main.py, lib/x.TS and a.b.txt or .env README.md x.py"], X.file_paths) == [["src/app/main.py", "lib/x.TS", "x.py"]]
    assert column(spark, ["in C++ not c", "use golang please", "python3 only", "c# code", "nothing"], X.language_hint) == ["cpp", "go", None, "csharp", None]


def tokens_by_walking(text):
    t = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text)
    t = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t)
    out = []
    for w in (w.lower() for w in re.sub("[^a-zA-Z0-9]+", " ", t).split() if len(w) > 1):
        out.append(w)
        if len(w) > 3:
            out += [p for p in sorted(set(X.CODE_PARTS), key=len, reverse=True) if p in w and p not in out]
    return sorted(out)


def test_code_tokens(spark):
    r = random.Random(0)
    texts = ["".join(r.choice([*X.CODE_PARTS, "Get", "File", "_", " ", "HTTP", "X", "9"]) for _ in range(r.randint(0, 14))) for _ in range(300)] + ["getFileProcessStatus fileStatusMap", ""]
    assert [sorted(t) for t in column(spark, texts, X.code_tokens)] == [tokens_by_walking(t) for t in texts]


def test_ids(spark):
    texts = ["a:b:c", "é/日:x", ""]
    assert column(spark, texts, H.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, t)) for t in texts]
    for key in (b"k", b"k" * 100):
        assert column(spark, texts, lambda c, key=key: H.hmac_sha256(key, c)) == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_signatures(spark):
    good = "sha256=" + hmac.new(b"s", b"body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("body", good), ("body", "sha256=0"), ("body", None)], "b string, h string")
    assert [r.v for r in df.select(H.valid_signature(b"s", F.col("b"), F.col("h")).alias("v")).collect()] == [True, False, False]


def test_paths_match(spark):
    rows = [("src/a.py", "src/a.py", True), ("x/src/a.py", "src/a.py", True), ("a.py", "src/a.py", True), ("lib/a.py", "src/a.py", False), ("src\\A.py", "SRC/a.py", True), ("", "a", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").select(X.paths_match(F.col("a"), F.col("b")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_both_text_chunkers_agree(spark):
    r = random.Random(1)
    texts = ["\n".join("x" * r.choice([0, 3, 40, 90, 160, 400]) for _ in range(r.randint(0, 40))) for _ in range(40)] + ["y" * 1000, "a\n" * 200, "\n\n", ""]
    got = column(spark, texts, lambda c: text_chunks(c, 300, 50))
    assert [[(c.content, c.start_line, c.end_line) for c in g] for g in got] == [code.pack_lines(t, 300, 50) for t in texts]


def test_chunks_cover_the_text(spark):
    text = "\n".join(f"line {i} " + "z" * (i % 50) for i in range(300))
    chunks = column(spark, [text], text_chunks)[0]
    assert chunks[0].start_line == 1 and chunks[-1].end_line == 300
    assert all(b.start_line <= a.end_line + 1 and len(a.content) <= 1650 for a, b in zip(chunks, chunks[1:], strict=False))


PYTHON = '''import os


class A(Base):
    """Doc."""

    x: int

    @property
    def y(self):
        def inner():
            pass
        return self.x

    async def z(self):
        pass


@decorated
def top():
    return 1


if True:
    def held():
        pass
'''


def test_python_chunks():
    rows = [(r[1], r[2], r[3], r[4], r[5]) for r in code.python_chunks(PYTHON)]
    assert rows == [(4, 8, "class_definition", None, "A"), (9, 13, "function_definition", "y", "A"), (15, 16, "function_definition", "z", "A"), (19, 21, "function_definition", "top", None), (25, 26, "function_definition", "held", None)]
    long = "def f():\n" + "".join(f"    v{i} = {i}\n" for i in range(400))
    cut = code.python_chunks(long)
    assert len(cut) > 1 and {r[7] for r in cut} == {"ast_split"} and {r[4] for r in cut} == {"f"} and cut[-1][2] == 401
    assert code.python_chunks("def (:") is None and code.source_chunks("  ", "python") == [] and code.source_chunks("var a", "javascript")[0][7] == "text"


def test_class_members():
    found = {(c, m, k) for c, m, k, _ in code.class_members(PYTHON + "\nclass B:\n    t = Column()\n    def __init__(self):\n        self.q = 1\n")}
    assert found == {("A", "x", "field"), ("A", "y", "property"), ("B", "t", "column"), ("B", "__init__", "method"), ("B", "q", "attribute")}
    assert ("C", "name", "field", 2) in code.class_members("class C:\n    name = 1\n    def go(self:\n")


def test_contract(spark):
    chunks = spark.createDataFrame([(1, "class User:\n    phone = Column()\n"), (2, "x = user.phone_number\n")], "k long, content string")
    models, refs = code.class_models(chunks, key="k"), code.schema_references(chunks, key="k", field="phone_number")
    issue = lambda c, f, r=refs: code.contract(models, r, key="k", class_name=c, field=f).first().issue
    assert issue("User", "phone_number") == "WRONG_FIELD_REFERENCE" and issue("Nobody", "phone_number") == "INSUFFICIENT"
    assert issue("User", "phone", code.schema_references(chunks, key="k", field="phone")) == "INSUFFICIENT"
    assert "WRONG_FIELD_REFERENCE" in code.contract_text(code.contract(models, refs, key="k", class_name="User", field="phone_number")).first().text


def test_evidence_scores(spark):
    row = dict(query="Fix getUserName in src/app/user_service.py of UserService", path="src/app/user_service.py", symbol="getUserName", class_name="UserService")
    df = spark.createDataFrame([tuple(row.values()), (row["query"], "billing/other.py", "charge", "Card")], "query string, path string, symbol string, class_name string")
    q = F.col("query")
    score = identify.evidence_score(query=q, identifiers=X.identifiers(q), keywords=X.keywords(q), file_paths=X.file_paths(q), path=F.col("path"), symbol=F.col("symbol"), class_name=F.col("class_name"), element_path=F.lit(None).cast("string"))
    a, b = [r.s for r in df.select(score.alias("s")).collect()]
    # path 20, stem in terms 10, stem in query 8, class 16+10+12 and "user service" is not said, symbol 8+6, keywords by substring
    assert a >= 20 + 10 + 8 + 38 + 14 and b == 0


def test_locate():
    src = "a\n  b = 1\n  c = 2  \nd\n  b = 1\n"
    assert verify.locate(src, "  c = 2", 10)[:2] == (12, 12)
    assert verify.locate(src, "b = 1")[3] == 2
    assert verify.locate(src, "\na\n")[:2] == (1, 1)
    assert verify.locate(src, "  c = 2\nd") == (3, 4, "  c = 2  \nd", 1)
    assert verify.locate("if x:\n    y = 1\n    z = 2\n", "y = 1\nz = 2") == (2, 3, "    y = 1\n    z = 2", 1)
    assert verify.locate(src, "nope")[3] == 0


def test_unified_diff():
    patch = verify.unified_diff("f.py", "a\nb\nc", "a\nB\nc", 10)
    assert patch.splitlines()[:3] == ["--- a/f.py", "+++ b/f.py", "@@ -10,3 +10,3 @@"] and verify.unified_diff("f", "a", "a", 1) is None


def test_verified_changes(spark):
    rows = [(1, "f.py", "x\ny\n", 1, "y", "z"), (2, "f.py", "x\nx\n", 1, "x", "z"), (3, "f.py", None, 1, "x", "z"), (4, "f.py", "x\n", 1, "x", "x")]
    got = verify.verify_changes(spark.createDataFrame(rows, "change_id long, file_path string, source string, base_line int, old_code string, new_code string"))
    assert [r.status for r in got.orderBy("change_id").collect()] == ["verified", "ambiguous", "not_found", "unchanged"]


def test_embedding_providers_are_checked(spark):
    df = spark.createDataFrame([("getUser name",), ("",)], "content string")
    a, b = [r.vector for r in embedding.embed(df).collect()]
    assert abs(np.linalg.norm(a) - 1) < 1e-9 and not any(b)
    with pytest.raises(Exception, match="the provider returned"):
        embedding.embed(df, provider=lambda t: np.zeros((len(t), 3))).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/a.py").write_text("print(1)")
    (tmp_path / "tree/sub/b c.md").write_text("# x")
    got = {r.file_path: r.size for r in files.local_tree(spark, f"file://{tmp_path}/tree").collect()}
    assert got == {"a.py": 8, "sub/b c.md": 3}
    wanted = spark.createDataFrame([("a.py",), ("gone.py",)], "file_path string")
    assert {r.file_path: (r.fetch_status, bytes(r.content)) for r in files.with_content(spark, f"file://{tmp_path}/tree", wanted).collect()} == {"a.py": ("success", b"print(1)"), "gone.py": ("failed", b"")}
    for name, entries in (("ok.zip", {"a.py": "x", "b/c.md": "y" * 50}), ("bad.zip", {"../evil": "x"}), ("many.zip", {f"f{i}": "x" for i in range(5)})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in entries.items():
                z.writestr(k, v)
    rows = files.read_archives(spark, f"file://{tmp_path}/*.zip", most_files=4, most_file_bytes=20).collect()
    assert {(r.archive, r.file_path) for r in rows if r.error is None} == {("ok.zip", "a.py")}
    assert {r.archive for r in rows if r.error} == {"bad.zip", "many.zip"} and all(r.commit_id.startswith("zip_") for r in rows)
    tree = spark.createDataFrame([("a", "blob", "s", None), ("d", "tree", "t", 3)], "path string, type string, sha string, size int")
    assert [tuple(r) for r in files.git_tree(tree).collect()] == [("a", "s", 0)]


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    assert store.read("t", "a int").count() == 0 and not store.exists("t")
    for i in range(5):
        store.write("t", spark.range(i).toDF("a"))
    assert store.read("t").count() == 4 and len(store.versions("t")) == 3
    (tmp_path / "s/t/v00000099").mkdir()
    assert store.read("t").count() == 4


def test_stream_remembers_deliveries(spark, tmp_path):
    rows = [(i % 5, None, "push" if i % 2 else "ping", 7, "refs/heads/main", "{}") for i in range(10)]
    spark.createDataFrame(rows, deliveries.SCHEMA).write.parquet(f"{tmp_path}/in/a")
    repos = spark.createDataFrame([(7, "r", "main")], "github_repo_id long, repo_id string, default_branch string")
    stream = lambda: deliveries.routed(deliveries.once(deliveries.read(spark, f"{tmp_path}/in/*")), repos)
    deliveries.run(stream(), deliveries.append_batches(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([(3, None, "push", 7, "refs/heads/main", "{}"), (77, None, "push", 8, "refs/heads/main", "{}")], deliveries.SCHEMA).write.parquet(f"{tmp_path}/in/b")
    deliveries.run(stream(), deliveries.append_batches(f"{tmp_path}/out"), f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.delivery_id for r in got) == [0, 1, 2, 3, 4, 77] and {r.outcome for r in got if r.delivery_id == 77} == {"ignored"}


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    wanted = spark.createDataFrame([("https://github.com/acme/tools", 5), ("https://example.org/x", 6)], "repo_url string, github_repo_id long")
    assert {r.repo_url: r.outcome for r in engine.register(wanted).collect()} == {"https://github.com/acme/tools": "created", "https://example.org/x": "invalid"}
    repo = engine.repositories().first()
    assert repo.full_name == "acme/tools" and repo.status == "pending"
    sources = {"src/users.py": "def get_user_name(user):\n    return user.name\n\n\ndef save_user(user):\n    store(user)\n", "docs/readme.md": "How to install the tools.\n", "node_modules/x.js": "ignored()", "bad.py": ""}
    rows = [(repo.repo_id, p, c, "failed" if p == "bad.py" else "success") for p, c in sources.items()]
    listing = lambda r: spark.createDataFrame(r, "repo_id string, file_path string, content string, fetch_status string")
    first = engine.ingest(listing(rows), job_id="j1", commit_sha="abc")
    assert {r.file_path: r.change for r in first["changes"].collect()} == {"src/users.py": "new", "docs/readme.md": "new", "bad.py": "failed"}
    assert [(j.status, j.files_changed) for j in engine.jobs().collect()] == [("partial", 2)] and engine.repositories().first().status == "active"
    assert {r.repo_url: r.outcome for r in engine.register(wanted.limit(1)).collect()} == {"https://github.com/acme/tools": "conflict"}
    again = engine.ingest(listing([r if r[1] != "src/users.py" else (*r[:2], r[2] + "\n\ndef delete_user(user):\n    pass\n", r[3]) for r in rows if r[1] != "docs/readme.md"]), job_id="j2")
    assert {r.file_path: r.change for r in again["changes"].collect()} == {"src/users.py": "modified", "docs/readme.md": "deleted", "bad.py": "failed"}
    points = engine.store.read("points")
    assert sorted(r.function_name for r in points.collect()) == ["delete_user", "get_user_name", "save_user"] and points.select("collection").distinct().count() == 1
    collection = points.first().collection
    queries = spark.createDataFrame([(1, "find get_user_name in src/users.py", "zip", f"/x/{collection.removeprefix('repo_local_').removeprefix('repo_')}.zip"), (2, " ", "git", "u"), (3, "find it", "git", "https://github.com/no/where"), (4, "find it", "git", None)], "query_id long, query string, source_type string, source_location string")
    from quarryloom.api import run_search

    got = {r.query_id: r for r in run_search(queries, points.withColumn("collection", F.lit("repo_local_" + collection.removeprefix("repo_")))).collect()}
    assert got[1].early_exit is None and got[1].top_file == "src/users.py" and got[1].intent == "RETRIEVE" and got[1].context.startswith("[3]{file,lines,function}:\n  src/users.py,1-2,get_user_name\n") and "[1] PRIMARY CODE src/users.py" in got[1].context and "get_user_name" in got[1].context and got[1].confidence == "medium"
    assert (got[2].early_exit, got[3].early_exit, got[4].early_exit) == ("blank query", "EARLY_EXIT_A", "missing source")
    events = spark.createDataFrame([(1, None, "push", 5, "refs/heads/main", "{}"), (1, None, "push", 5, "refs/heads/main", "{}"), (2, None, "ping", 5, None, "{}"), (3, None, "star", 5, None, "{}")], deliveries.SCHEMA)
    assert {r.delivery_id: r.outcome for r in engine.receive(events).collect()} == {1: "accepted", 2: "ok", 3: "ignored"}
    assert {r.delivery_id for r in engine.receive(events).collect()} == {3}
    engine.delete_index(points.select("repo_id"))
    assert engine.store.read("points").count() == 0 and engine.repositories().first().status == "pending"
    engine.delete(engine.repositories().select("repo_id"))
    assert engine.repositories().count() == 0 and engine.jobs().count() == 0
