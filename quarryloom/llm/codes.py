"""Product codes of vectors with exact integer arithmetic.

Components become integers floor(1024 * x).  Distances come from one matrix product a batch: integers are cut into limbs
so small that a product of two limbs, summed over a part, stays under 2^53 and is exact in float64; the limbs' products
are shifted and added in int64, and the first smallest distance wins.  Codebooks are refined by whole-table rounds:
every task adds up its own vectors by entry, Spark adds up the tasks' sums, and the driver gets one row for each entry and
position, whatever the table's size.  Integers are added and compared only, so no result depends on partitioning.

Odd rows: vectors that are null or hold a null or non-finite component are left out.  Vectors of other lengths are padded
with zeros to the longest, rounded up to four; an empty vector is all zeros.  Null ids come last where ids are ordered;
repeated ids are ordered by their vectors, and each row has its own result.  Fewer vectors than entries make smaller
codebooks; an empty table gives no rows.  Integers are held at +-2^62, and errors at 2^63 - 1, which only components beyond 10^8 can reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.common import filed, join_hot
from quarryloom.sources.tables import spread

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are looked at together.
ROWS = 4096
LARGEST = 1 << 62
#: Sums are kept as two numbers, of which the lower has so many bits.
LOW = 26


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 digits of so many bits, lowest first; the last one carries the sign."""
    out = []
    while a.size and (a.max() >= 1 << bits or a.min() < -(1 << bits)):
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices, exact modulo 2^64."""
    width = max(1, x.shape[1])
    bits = (53 - (width - 1).bit_length()) // 2
    total = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if bits * (i + j) < 64:
                total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest row of the book, and the squared distance."""
    most = sum(max(abs(int(a.max())), abs(int(a.min()))) for a in (x, book)) if x.size and book.size else 0
    if x.shape[1] * most * most < 1 << 63:
        far = (x * x).sum(1)[:, None] - 2 * products(x, book) + (book * book).sum(1)[None, :]
        at = far.argmin(1)
        return at, far[np.arange(len(x)), at]
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for k, row in enumerate(x.astype(object)):
        d = ((book.astype(object) - row) ** 2).sum(1)
        at[k] = min(range(len(d)), key=d.__getitem__)
        far[k] = min(d[at[k]], (1 << 63) - 1)
    return at, far


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """A list array as a matrix of floor(SCALE * x), padded with zeros."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)
    long = np.diff(vectors.offsets.to_numpy())
    if len(long) and (long == width).all():
        return whole.reshape(len(long), width)
    out = np.zeros((len(long), width), np.int64)
    out[np.arange(width)[None, :] < long[:, None]] = whole
    return out


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, integers(piece.column("embedding"), width)


def _sums(books: np.ndarray):
    """For each task: the sums by part, entry and position, the last position being the number of rows."""
    parts, entries, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = (np.zeros((parts, entries, w + 1), np.int64) for _ in range(2))
        for _, x in _pieces(batches, parts * w):
            small = not x.size or int(np.abs(x).max()) < 1 << LOW
            for p in range(parts):
                own = x[:, p * w : (p + 1) * w]
                at, _ = nearest(own, books[p])
                low[p, :, w] += np.bincount(at, minlength=entries)
                for k in range(w):
                    # at most ROWS numbers of LOW bits: exact in float64; the upper ones are, by twos
                    low[p, :, k] += np.bincount(at, own[:, k] if small else own[:, k] & ((1 << LOW) - 1), entries).astype(np.int64)
                    if not small:
                        high[p, :, k] += np.bincount(at, own[:, k] >> LOW, entries).astype(np.int64)
        slot = np.flatnonzero((low != 0) | (high != 0))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(low.ravel()[slot]), pa.array(high.ravel()[slot])], ["slot", "low", "high"])

    return run


def _coded(books: np.ndarray):
    parts, _, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _pieces(batches, parts * w):
            found = [nearest(x[:, p * w : (p + 1) * w], books[p]) for p in range(parts)]
            code = ["".join(f"{int(i):02x}" for i in row) for row in np.stack([at for at, _ in found], 1)]
            far = np.stack([d for _, d in found], 1)
            error = far.sum(1)
            for k in np.flatnonzero(far.astype(np.float64).sum(1) > 9e18):
                error[k] = min(sum(map(int, far[k])), (1 << 63) - 1)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in piece.schema.names if c != "embedding"), pa.array(code), pa.array(error)], [*(c for c in piece.schema.names if c != "embedding"), "code", "error"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))


def train(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of usable rows with vec_id and embedding: the first ones by id, refined by so many rounds over all."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = vectors.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    start = integers(first.column("embedding").combine_chunks(), width) if first.num_rows else np.zeros((0, width), np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    w = width // parts
    for _ in range(rounds if books.size else 0):
        found = vectors.select("embedding").mapInArrow(_sums(books), "slot long, low long, high long").groupBy("slot").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toArrow()
        sums = np.zeros(parts * len(start) * (w + 1), object)
        for slot, low, high in zip(*(found.column(c).to_pylist() for c in ("slot", "low", "high")), strict=True):
            sums[slot] = low + (high << LOW)
        sums = sums.reshape(parts, len(start), w + 1)
        for p, e in np.argwhere(sums[:, :, w] != 0):
            books[p, e] = [s // sums[p, e, w] for s in sums[p, e, :w]]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns of keep, code and error of each usable row."""
    kinds = dict(vectors.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return vectors.select(*keep, "embedding").mapInArrow(_coded(books), f"{schema}, code string, error long")


def op11_codes(spark, sf_dir: str) -> DataFrame:
    """All usable embeddings; what a label's rows err in all is added up before it is joined, hot labels are dealt out."""
    vectors = usable(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")))
    books = train(vectors)
    coded = filed(encode(vectors, books, ["vec_id", "label"]).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    summed = F.sum(F.col("error").cast("decimal(20,0)"))
    sums = coded.groupBy("key").agg(F.least(summed, F.lit((1 << 63) - 1)).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_hot(coded, sums, "key", "n").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    near = "SELECT a.vec_id, a.p, a.v, min(256 * (a.n + b.n - 2 * list_inner_product(a.v, b.v))::BIGINT + b.e) AS m FROM parts a JOIN book{k} b USING (p) GROUP BY ALL"
    book = """SELECT b.p, b.e, coalesce(s.v, b.v) AS v, list_inner_product(coalesce(s.v, b.v), coalesce(s.v, b.v)) AS n
        FROM book{k} b LEFT JOIN (
            SELECT p, e, list(floor(x) ORDER BY i) AS v FROM (
                SELECT p, e, i, sum(x)::DOUBLE / count(*) AS x FROM (SELECT p, m % 256 AS e, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{k}) GROUP BY ALL
            ) GROUP BY ALL
        ) s USING (p, e)"""
    rounds = "".join(f"near{k} AS MATERIALIZED ({near.format(k=k)}),\n" + (f"book{k + 1} AS MATERIALIZED ({book.format(k=k)}),\n" if k < ROUNDS else "") for k in range(ROUNDS + 1))
    return f"""WITH kept AS MATERIALIZED (
    SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
    SELECT vec_id, p, v, list_inner_product(v, v) AS n FROM (SELECT vec_id, p, q[p * len(q) // 4 + 1 : (p + 1) * len(q) // 4] AS v FROM kept, range(4) t(p))),
book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v, n FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
{rounds}coded AS (SELECT vec_id, string_agg(format('{{:02x}}', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id),
hashed AS (SELECT sha256(string_agg(array_to_string([x::BIGINT FOR x IN v], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), hashed"""


OP11_SQL = _sql()
