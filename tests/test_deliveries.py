"""Patches, validation rounds, archives into the engine, mixed values and work that is tried again."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarryloom.api import Engine
from quarryloom.functions.values import normalize_suggestion
from quarryloom.operators import context, patches
from quarryloom.operators.verify import unified_diff
from quarryloom.sources import files
from quarryloom.streaming import deliveries
from quarryloom.streaming.work import WorkLog


def test_patches(spark):
    source = "a\r\nb\r\nc\r\nd"
    good = "--- a/x\n+++ b/x\n@@ -2,2 +2,3 @@\n b\n-c\n+C\n+c2"
    rows = [
        (1, source, [good]), (2, "new\n" + source.replace("\r", "") + "\n", [good]), (3, "b\nc\nb\nc\n", ["@@ -7,2 +7 @@\n b\n-c\n"]), (4, source, [good, good]), (5, source, []), (6, None, None),
        (7, source, ["no diff"]), (8, source, ["@@ -1,3 +1 @@\n a\n"]), (9, "", ["@@ -0,0 +1,2 @@\n+x\n+y\n"]), (10, "x\ny", ["@@ -2 +2 @@\n-y\n+z\n\\ No newline at end of file\n"]), (11, source, ["@@ -4 +3,0 @@\n-d\n", "@@ -1 +1 @@\n-a\n+A\n"]), (11, source, [None, ""]),
    ]
    df = spark.createDataFrame(rows, "file_id int, source string, patches array<string>").withColumn("status", F.lit("clash"))
    got = sorted(map(tuple, patches.apply_patches(df).collect()), key=str)
    want = [
        (1, "a\r\nb\r\nC\r\nc2\r\nd", 1, "applied"), (2, "new\na\nb\nC\nc2\nd\n", 1, "applied"), (3, None, 1, "rejected"), (4, None, 2, "rejected"), (5, source, 0, "unchanged"), (6, "", 0, "unchanged"), (7, None, 0, "malformed"),
        (8, None, 0, "malformed"), (9, "x\ny\n", 1, "applied"), (10, "x\nz", 1, "applied"), (11, "A\r\nb\r\nc", 2, "applied"), (11, source, 0, "unchanged"),
    ]
    assert got == sorted(want, key=str) and patches.apply_patches(df.limit(0)).count() == 0
    long = "\n".join(f"line {i}" for i in range(60_000))
    patch = unified_diff("x", long, long.replace("line 3\n", "l3\n").replace("line 59000\n", ""), 1)
    assert patch.count("@@ -") == 2 and patches.apply_hunks(long + "\n", patches.hunks(patch)) == long.replace("line 3\n", "l3\n").replace("line 59000\n", "") + "\n"


def test_checks_of_patches_and_suggestions(spark):
    df = spark.createDataFrame([("p", "c", "passed"), (None, "c", "passed"), ("p", "c", "failed"), ("p", "c", None), (None, None, None)], "patch string, change string, validation string")
    assert [r[0] for r in df.select(patches.patch_check(F.col("patch"), F.col("change"), F.col("validation"))).collect()] == ["passed", "failed", "failed", "passed", "not_run"]
    df = spark.createDataFrame([("FIX_BUG", None, None), ("FIX_BUG", "x", "I CANNOT DETERMINE it"), ("ADD_FEATURE", " ", "fine"), ("REFACTOR", " ", "wait, no")], "intent string, proposal string, text string")
    assert [len(r[0]) for r in df.select(patches.suggestion_errors(F.col("intent"), F.col("proposal"), F.col("text"))).collect()] == [1, 1, 0, 2]


def test_rounds_hold_only_what_failed(spark):
    rounds = []

    def check(pending):
        rounds.append(pending.count())
        return pending.where("left > 0").select("query_id", F.array(F.concat(F.lit("left "), F.col("left").cast("string"))).alias("errors"))

    again = lambda failing: failing.where("query_id != 6").withColumn("left", F.col("left") - 1)
    rows = [(1, None, 0), (2, "AVAILABLE", 1), (3, "", 2), (4, "", 3), (5, "UNAVAILABLE", 9), (6, "", 1)]
    df = spark.createDataFrame(rows, "query_id int, analysis_status string, left int")
    got = {r.query_id: (r.validation, r.retries, r.errors, r.early_exit, r.left) for r in patches.validate(df, check, again).collect()}
    assert got.pop(5)[:2] == ("unavailable", 0)
    assert got == {1: ("passed", 0, [], None, 0), 2: ("passed", 1, [], None, 0), 3: ("passed", 2, [], None, 0), 4: ("failed", 2, ["left 1"], "EARLY_EXIT_D", 1), 6: ("unavailable", 1, ["left 1"], None, 1)}
    assert rounds == [5, 3, 2] and patches.validate(df.limit(0), check, again).count() == 0


def test_mixed_values(spark):
    rows = ["{'a': 1, 'b': (1, None)}", '{"description": " x "}', "{'description': 5}", '["a", {"b": "ü"}]', " plain ", "", None, "{1, 2}", "[b'x']", "{bad", "[" * 5000, '"quoted"', '{"description": null, "k": NaN}', "({'description': 'deep'})", "\u2003x\u00a0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(normalize_suggestion(F.col("v"))).collect()]
    assert got == [json.dumps({"a": 1, "b": [1, None]}), "x", "5", '["a", {"b": "ü"}]', "plain", None, None, "{1, 2}", "[b'x']", "{bad", "[" * 5000, '"quoted"', '{"description": null, "k": NaN}', "deep", "x"]


def test_serialised_context(spark):
    schema = "q int, ord int, file_path string, start_line int, end_line int, function_name string, class_name string, chunk_type string, repository string"
    rows = [(1, 2, "b,c.py", None, 3, "", None, None, None), (1, 1, "a.py", 1, 9, 'say "hi"\n', None, "", ""), (2, 1, None, 1, None, None, "5", "true", "r")]
    got = {r.q: r.text for r in context.toon(spark.createDataFrame(rows, schema), group=["q"]).collect()}
    assert got == {1: '[2]{file,lines,function}:\n  a.py,1-9,"say \\"hi\\"\\n"\n  "b,c.py",?,""', 2: '[1]{file,lines,class,type,repo}:\n  unknown,?,"5","true",r'}


def packed(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archives_into_the_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    engine.register(spark.createDataFrame([(f"https://github.com/acme/{n}",) for n in "abcde"], "repo_url string"))
    ids = {r.repo_url[-1]: r.repo_id for r in engine.repositories().collect()}
    one = packed({"src/x.py": "def one():\n    pass\n", "big.py": "x" * 500, "node_modules/y.js": "1"})
    rows = [("a", one), ("b", packed({"../evil.py": "1", "ok.py": "2"})), ("c", one[:40]), ("d", packed({})), ("e", one), ("e", packed({"z.py": "z = 1\n"}))]
    frame = lambda found: spark.createDataFrame([(ids[k], v) for k, v in found], "repo_id string, content binary")
    engine.ingest_archives(frame(rows), job_id="j1", most_file_bytes=100)
    jobs = {r.repo_id: (r.status, r.error) for r in engine.jobs().collect()}
    assert jobs[ids["a"]] == ("completed", None) and {k: jobs[ids[k]][0] for k in "bcde"} == dict.fromkeys("bcde", "failed")
    assert "unsafe path" in jobs[ids["b"]][1] and "no file" in jobs[ids["d"]][1] and "several" in jobs[ids["e"]][1]
    assert [(r.repo_id, r.file_path) for r in engine.store.read("chunk_registry").collect()] == [(ids["a"], "src/x.py")]
    shas = {r.repo_id: r.last_indexed_commit_sha for r in engine.repositories().collect()}
    assert shas[ids["a"]].startswith("zip_") and shas[ids["b"]] is None
    engine.ingest_archives(frame([("a", packed({"src/y.py": "def two():\n    pass\n"}))]), job_id="j2")
    assert [r.function_name for r in engine.store.read("points").collect()] == ["two"]
    assert engine.ingest_archives(frame([("b", b"junk")]), job_id="j3")["changes"].count() == 0
    with pytest.raises(ValueError, match="not registered"):
        engine.ingest_archives(spark.createDataFrame([("nobody", one)], "repo_id string, content binary"), job_id="j4")


def test_members_that_lie_or_come_in_parts(spark, monkeypatch):
    data = packed({f"f{i}.py": str(i) * 1000 for i in range(9)})
    frame = spark.createDataFrame([(1, data), (2, None), (3, data[:-200])], "k int, content binary")
    monkeypatch.setattr(files, "AT_ONCE", 2500)
    rows = files.archive_members(frame, key="k").collect()
    assert sorted(r.file_path for r in rows if r.k == 1) == [f"f{i}.py" for i in range(9)] and {r.k for r in rows if r.error} == {2, 3}
    # the directory says that a member is shorter than it is
    short = data.replace((1000).to_bytes(4, "little"), (10).to_bytes(4, "little"))
    with pytest.raises((ValueError, zipfile.BadZipFile)):
        list(files.archive_entries(short))


START = dt.datetime(2030, 1, 1)


def test_work_is_tried_again_and_given_up(spark, tmp_path):
    log = WorkLog(spark, f"file://{tmp_path}/work", retries=1)
    rows = [(1, "a", START, "x"), (1, "a", START, "x"), (2, "a", START, "bad"), (3, "b", START, "once"), (4, "b", START, "lost"), (None, "b", START, ""), (5, None, START, "")]
    batch = spark.createDataFrame(rows, "delivery_id long, repo_id string, received_at timestamp, payload string")
    log.receive(batch, START)
    log.receive(batch, START)
    act = lambda due: due.where("payload != 'lost'").select("delivery_id", F.expr("CASE WHEN payload = 'bad' OR payload = 'once' AND attempts = 0 THEN 'no luck' END").alias("error"))
    assert log.work_off(act, START) == 4 and log.work_off(act, START) == 0
    assert {r.delivery_id: (r.state, r.attempts, r.error) for r in log.work().collect()} == {1: ("done", 1, None), 2: ("waiting", 1, "no luck"), 3: ("waiting", 1, "no luck"), 4: ("waiting", 1, "no result")}
    assert log.work_off(act, START + log.pause) == 3
    assert {(r.delivery_id, r.error) for r in log.dead_letters().collect()} == {(2, "no luck"), (4, "no result")}
    assert {tuple(r) for r in log.progress().select("repo_id", "done", "dead", "last_delivery_id").collect()} == {("a", 1, 1, 1), ("b", 1, 1, 3)}


def test_a_worker_that_dies_or_meets_another(spark, tmp_path):
    log = WorkLog(spark, f"file://{tmp_path}/work")
    log.receive(spark.createDataFrame([(i, "a", START, "") for i in range(6)], "delivery_id long, repo_id string, received_at timestamp, payload string"), START)
    fine = lambda due: due.select("delivery_id", F.lit(None).cast("string").alias("error"))

    def raising(due):
        raise RuntimeError("down\nmore")

    log.work_off(raising, START)
    assert {(r.state, r.error) for r in log.work().collect()} == {("waiting", "RuntimeError: down")}

    def killed(due):
        raise KeyboardInterrupt

    later = START + log.pause
    with pytest.raises(KeyboardInterrupt):
        log.work_off(killed, later)  # not acknowledged: due as before

    def meeting(due):
        log.work_off(fine, later)
        return due.select("delivery_id", F.lit("late").alias("error"))

    log.work_off(meeting, later)
    assert {(r.state, r.attempts) for r in log.work().collect()} == {("done", 2)} and log.progress().first().done == 6


def test_stream_restarts_amid_its_batches(spark, tmp_path):
    root, schema = f"file://{tmp_path}", deliveries.SCHEMA.replace("github_repo_id long, ref string", "repo_id string")
    for k in range(3):
        spark.createDataFrame([(i, START, "push", str(i % 2), "") for i in range(4 * k, 4 * k + 6)], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    log, fine = WorkLog(spark, f"{root}/work"), lambda due: due.select("delivery_id", F.lit(None).cast("string").alias("error"))
    stream = lambda: deliveries.read(spark, f"{root}/in", schema=schema, files_per_batch=1)

    def dying(batch, n):
        log.batch(fine)(batch, n)
        if n == 1:
            raise RuntimeError("gone after the commit, before the stream's own")

    with pytest.raises(Exception, match="gone after"):
        deliveries.run(stream(), dying, f"{root}/checkpoint").awaitTermination()
    deliveries.run(stream(), log.batch(fine), f"{root}/checkpoint").awaitTermination()
    assert sorted(r.delivery_id for r in log.work().where("state = 'done' AND attempts = 1").collect()) == list(range(14))
    assert {r.repo_id: r.done for r in log.progress().collect()} == {"0": 7, "1": 7}
