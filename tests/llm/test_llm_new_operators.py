"""Product codes, personal data and importance resampling against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quarryloom.llm import codes, personal, resampling

SF = "/root/testdata/sf0.001"


# ---- product codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts) * parts
    w = width // parts
    ints = [[math.floor(x) * 1024 if abs(x) >= 2**53 else math.floor(x * 1024) for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0], rows[k][1]))[:entries]
    books = [[ints[k][p * w : (p + 1) * w] for k in order] for p in range(parts)]

    def near(p, q):
        return min(((sum((a - b) ** 2 for a, b in zip(q[p * w : (p + 1) * w], c, strict=True)), e) for e, c in enumerate(books[p])))

    for _ in range(rounds):
        for p, at in [(p, [near(p, q)[1] for q in ints]) for p in range(parts)]:
            for e in set(at):
                own = [q[p * w : (p + 1) * w] for q, x in zip(ints, at, strict=True) if x == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[near(p, q) for p in range(parts)] for q in ints]
    error = [min(sum(d for d, _ in f), 2**63 - 1) for f in found]
    by_label = {}
    for (_, _, lab), e in zip(rows, error, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), x, min(by_label[lab], 2**63 - 1), digest) for (i, _, lab), f, x in zip(rows, found, error, strict=True)), key=str)


def run_codes(spark, tmp_path, rows, kind="float", extra=""):
    # the file's name is the query's table
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int{extra}").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, codes.op11_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_equal_plain_integers(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, [r.choice([-0.5, 0.25, r.uniform(-2, 2)]) for _ in range(8)], r.choice([None, 0, 0, 1])) for k in range(60)]
    rows += [(7, rows[7][1], 1), (None, [0.125] * 8, None), (61, [1.0, None] * 4, 0), (62, [float("nan")] * 8, 0), (63, [float("inf")] + [0.0] * 7, 0), (64, None, 0), (65, [], 2), (66, [0.5] * 3, 2)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert run_codes(spark, tmp_path, rows) == plain_codes(rows)


def test_codes_are_exact_where_float64_is_not(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, [r.uniform(-1, 1) * 10 ** r.choice([0, 4, 6, 9]) for _ in range(8)], k % 2) for k in range(280)]
    assert run_codes(spark, tmp_path, rows, "double") == plain_codes(rows)


def test_codes_of_empty_tables_and_of_clashing_columns(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert run_codes(spark, tmp_path / "a", []) == []
    rows = [(k, [float(k % 3)] * 4, None, "x", 1, 2) for k in range(9)]
    got = run_codes(spark, tmp_path, rows, extra=", code string, error int, key int")
    assert got == plain_codes([x[:3] for x in rows])


def test_limb_products_are_exact():
    r = np.random.default_rng(1)
    x, y = r.integers(-(1 << 44), 1 << 44, (9, 16)), r.integers(-(1 << 12), 1 << 12, (7, 16))
    assert (codes.products(x, y).astype(object) == x.astype(object) @ y.astype(object).T).all()
    assert all(abs(a).max() * abs(b).max() * 16 <= 2.0**53 for a in codes.limbs(x, 24) for b in codes.limbs(y, 24))
    at, far = codes.nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [5, 5]]))
    assert at.tolist() == [0, 2] and far.tolist() == [1, 0]


def test_codes_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({codes.OP11_SQL})").fetchall())
    assert sorted(map(tuple, codes.op11_codes(spark, SF).select(columns).collect())) == want and len(want) == 500


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if kind == "ip"), "card": 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    texts = ["".join(r.choice(["@", ".", "a", "B-", "+", "12", "0", " ", "-", "255", "é", "😀", "(", "4111111111111111", "256", "%"]) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a@@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "+1 ) . -", "0001.1.1.1", "x@y", "@a.b", "4111 1111-1111 1111 5"]
    for t in texts:
        assert personal.base_spans(t) == plain_base(t), t


def test_base_spans_are_linear_in_runs():
    for t in ("7" * 400_000, "a" * 400_000 + "@", "+1" + " " * 400_000, "1." * 200_000, "a@" * 200_000):
        personal.base_spans(t)


def test_viterbi_finds_the_best_of_all_paths():
    r = np.random.default_rng(2)
    lengths = np.array([1, 3, 4, 2])
    emitted, pairs, first = r.normal(size=(4, 4, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    got = personal.viterbi(emitted, lengths, pairs, first)
    for k, n in enumerate(lengths):
        value = lambda p: first[p[0]] + sum(emitted[k, i, x] for i, x in enumerate(p)) + sum(pairs[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(got[k, :n]) == max(itertools.product(range(3), repeat=int(n)), key=value)


def test_field_on_sentences_it_has_not_seen():
    decoder, hit, wrong, missed = personal.Decoder(personal.default_field()), 0, 0, 0
    rows = personal.labelled_table(600, seed=99)
    base = [personal.base_spans(t) for t, _ in rows]
    for (_, want), b, more in zip(rows, base, decoder.added([t for t, _ in rows], base), strict=True):
        got = set(b) | set(more)
        hit, wrong, missed = hit + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    assert hit >= 285 and wrong <= 6 and missed <= 15
    text = "Please call (771) 555-1655 or write to jane at example dot com."
    assert decoder.added([text], [[]])[0] == [("email", 39, 62), ("phone", 12, 26)]


def test_field_alone_or_in_company_and_over_cuts():
    decoder = personal.Decoder(personal.default_field())
    texts = ["", "ÄÖ call (771) 555-1655 x", "none here", "1 " * 700 + "call (771) 555-1655 then " + "2 " * 300]
    alone = [decoder.added([t], [[]])[0] for t in texts]
    assert alone == decoder.added(texts, [[]] * 4) and [len(a) for a in alone] == [0, 1, 0, 1]
    assert texts[1][alone[1][0][1] : alone[1][0][2]] == "(771) 555-1655"
    long = "word " * 250_000 + "call (771) 555-1655 now"
    assert [long[s:e] for _, s, e in decoder.added([long], [[]])[0]] == ["(771) 555-1655"]
    near = "w" * (personal.PIECE - 8) + " call (771) 555-1655 now"
    assert [near[s:e] for _, s, e in decoder.added([near], [[]])[0]] == ["(771) 555-1655"]


def test_personal_query_and_odd_rows(spark, tmp_path):
    rows = [(1, None, 0), (2, "", 0), (3, "a.b@c.de 10.0.0.1 +1 (771) 555-1655, 4111111111111111", 0), (3, "a.b@c.de", 0), (None, "é😀 x@y.z", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, base int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.spans): r for r in personal.op12_personal(spark, str(tmp_path)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and got[1, ""].base_sha256 == got[2, ""].base_sha256 == none
    whole = "email:0:8,ip:9:17,card:37:53,phone:18:35"
    assert (3, whole) in got and got[3, whole].base_sha256 == hashlib.sha256(whole.encode()).hexdigest() and tuple(got[3, whole])[1:5] == (1, 1, 1, 1)
    assert (None, "email:3:8") in got
    found = personal.op12_personal(spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in found:
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(","))
    assert len(found) == len(docs)


# ---- importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def plain_resampling(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for f in plain_features(text)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in plain_features(text)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        words, found = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    can = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(can[: 5 * len(can) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_resampling_equals_the_plain_version(spark, tmp_path, parts):
    r = random.Random(6)
    word = lambda: r.choice(["a", "Be", "straße", "ß9", "0", "x" * 70, "😀", "the", "Of"])
    docs = [(k, r.choice([" ", ",", "\n\n", "-"]).join(word() for _ in range(r.choice([0, 1, 2, 19, 20, 21, 200])))) for k in range(300)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (None, docs[6][1]), (900, None), (901, " ,"), (902, " ".join(word() for _ in range(60_000)))]
    target = [" ".join(word() for _ in range(30)) for _ in range(5)] + [None]
    spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, bucket int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(t,) for t in target], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, resampling.op13_resampling(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = plain_resampling(docs, target)
    assert got == want and sum(x[4] is not None for x in want) > 5


def test_resampling_of_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = resampling.op13_resampling(spark, SF)
    assert sorted(map(tuple, found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == plain_resampling(docs, target)


def test_resampling_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert resampling.op13_resampling(spark, str(tmp_path)).collect() == []


def test_crc_of_what_is_appended():
    r = random.Random(8)
    pairs = [(r.randbytes(r.randint(0, 9)), r.randbytes(r.choice([1, 2, 3, 3000]))) for _ in range(200)]
    got = resampling.appended(*(np.array(x, np.uint32) for x in ([zlib.crc32(a) for a, _ in pairs], [zlib.crc32(b) for _, b in pairs])), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
