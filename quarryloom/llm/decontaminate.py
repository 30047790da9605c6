"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Words are runs of lower-cased ASCII letters, digits and non-ASCII characters.  An item's windows are its runs of
WINDOW consecutive words (all its words if it has fewer).  Each text is normalised once, to its words between single
spaces, and read once by the automaton; offsets of hits are mapped back to the text as it came.

The automaton holds the distinct windows of the benchmark, about forty times their bytes, once in each worker process.
A benchmark above BLOCK_BYTES of windows is cut into blocks by the windows' hashes; blocks pass through the driver one
at a time, each with an automaton and a scan of its own over documents that were given row numbers and written once, and
their hits are united by row.  So what driver and executors hold is bounded whatever the benchmark's size.

Nulls: a null text, of a document or an item, has no words; a null item id is not reported.  Rows of a repeated item
id are united.  Repeated documents are reported once for each row.  Empty tables give no hits or no rows.
Other columns are ignored by `find_contamination` and kept by `drop_contaminated`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.common import cut, fresh_dir
from quarryloom.sources.tables import spread

WINDOW = 10
#: Windows in one automaton, as bytes of their normalised text, with items' names counted as ITEM_BYTES each.
BLOCK_BYTES = 2 << 20
ITEM_BYTES = 16

#: Bytes that belong to words stay, A-Z become a-z, all others become spaces.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))

SCHEMA = "row long, doc_id long, n_words long, hits array<struct<first:long,last:long>>, spans array<struct<start:long,end:long>>, items array<string>"


def normalise(text: str | None) -> tuple[bytes, list[bytes]]:
    """The text's bytes with all that is not of a word blanked, and its words."""
    blanked = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    return blanked, blanked.split()


def windows(text: str | None, length: int = WINDOW) -> set[bytes]:
    words = normalise(text)[1]
    if not words:
        return set()
    return {b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))}


def _automaton(patterns: list[tuple[bytes, list[str]]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for window, items in patterns:
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(items)))
    found.make_automaton()
    return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive ranges, sorted and united where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan_text(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]], list[str]]:
    """Number of words, inclusive ranges of hit words, their spans in the text (code points, end exclusive), items."""
    blanked, words = normalise(text)
    if not words or not len(automaton):
        return len(words), [], [], []
    line = b" ".join([b"", *words, b""])
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return len(words), [], [], []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found]) - 1
    ranges = merged([(int(b) - n + 1, int(b)) for b, (_, (n, _)) in zip(last, found, strict=True)])
    raw = np.frombuffer(blanked, np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before a byte
    spans = [(int(points[starts[a]]), int(points[ends[b]])) for a, b in ranges]
    return len(words), ranges, spans, sorted({x for _, (_, items) in found for x in items})


_BUILT: dict[str, object] = {}


def _built(name: str, patterns):
    """The automaton of a broadcast block: built once in each worker process, which keeps the last one."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _automaton(patterns.value)
    return _BUILT[name]


def _scanner(patterns):
    name = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton = _built(name, patterns)
            rows, ids = batch.column("row"), batch.column("doc_id")
            found = [scan_text(automaton, t.as_py()) for t in batch.column("text")]
            pairs = lambda k, a, b: pa.array([[{a: x, b: y} for x, y in f[k]] for f in found], pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [rows, ids, pa.array([f[0] for f in found], pa.int64()), pairs(1, "first", "last"), pairs(2, "start", "end"), pa.array([f[3] for f in found], pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "hits", "spans", "items"],
            )

    return scan


def _windows_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(w.decode("latin-1"), i.as_py()) for i, t in zip(batch.column("item"), batch.column("text"), strict=True) for w in windows(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["window", "item"])


def _blocks(benchmark: DataFrame, item_column: str, item_text: str, block_bytes: int) -> tuple[int, Iterator]:
    """How many blocks the distinct windows and their items are cut into, and the blocks, each broadcast when it is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text"))
    listed = cut(items.mapInArrow(_windows_of_items, "window string, item string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")))
    size = listed.agg(F.sum(F.octet_length("window") + (F.size("items") + 1) * ITEM_BYTES)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))

    def made() -> Iterator:
        for k in range(n):
            block = listed.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
            yield spark.sparkContext.broadcast([(r["window"].encode("latin-1"), r["items"]) for r in block.toLocalIterator()])

    return n, made()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, as they are, in whose texts no window of the benchmark occurs."""

    def sieve(patterns):
        name = uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                automaton = _built(name, patterns)
                yield batch.filter(pa.array([not scan_text(automaton, t.as_py())[1] for t in batch.column(text_column)], pa.bool_()))

        return keep

    n, blocks = _blocks(benchmark, item_column, item_text, block_bytes)
    for patterns in blocks:
        docs = docs.mapInArrow(sieve(patterns), docs.schema)
        if n > 1:  # one automaton at a time
            where = fresh_dir(docs.sparkSession, "sieved")
            docs.write.parquet(where)
            docs = docs.sparkSession.read.schema(docs.schema).parquet(where)
            patterns.unpersist()
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns: doc_id, n_words, hits (inclusive ranges of words), spans (code points of the text), items (sorted ids)."""
    spark = docs.sparkSession
    n, blocks = _blocks(benchmark, item_column, item_text, block_bytes)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    if n == 1:
        return rows.withColumn("row", F.lit(0).cast("long")).mapInArrow(_scanner(next(blocks)), SCHEMA).drop("row")
    where, hits = fresh_dir(spark, "numbered"), fresh_dir(spark, "hits")
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(where)
    numbered = spark.read.parquet(where)
    for k, patterns in enumerate(blocks):
        found = numbered.mapInArrow(_scanner(patterns), SCHEMA)
        # every row is in the first block's result, in the others only rows with a hit
        (found if k == 0 else found.where(F.size("hits") > 0)).write.mode("append").parquet(hits)
        patterns.unpersist()
    every = spark.read.schema(SCHEMA).parquet(hits)
    united = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "spans", "items")])
    joined = lambda c, a, b, gap: F.aggregate(
        F.sort_array(c),
        F.expr(f"cast(array() as array<struct<{a}:long,{b}:long>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x[a] <= F.element_at(acc, -1)[b] + gap), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)[a].alias(a), F.greatest(F.element_at(acc, -1)[b], x[b]).alias(b))))).otherwise(F.concat(acc, F.array(x))),
    )
    return united.select("doc_id", "n_words", joined("hits", "first", "last", 1).alias("hits"), joined("spans", "start", "end", 0).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    found = find_contamination(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
),
worded AS (SELECT kind, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
item_windows AS (
  SELECT DISTINCT id AS item_id, array_to_string(w[i : i + 9], ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM worded WHERE kind = 'b' AND len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM worded, lengths WHERE kind = 'd' AND len(w) >= n)
),
found AS (SELECT d.id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.win = b.win AND d.n = b.n),
hit AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT id, i, n FROM found)) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM worded w LEFT JOIN hit h ON h.id = w.id LEFT JOIN items i ON i.id = w.id WHERE w.kind = 'd'
"""
