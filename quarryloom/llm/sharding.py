"""Size-balanced sharding by sampled splitters.

Rows are ordered by (hash of the text, id).  Splitters come from a sample in which a row is drawn with a chance in
proportion to its size; quantiles of that sample cut the order into ranges, and a range whose exact size is over the
limit is cut again by a sample of its own.  Splitters are (hash, id) pairs, so a group of equal texts that is larger
than a range is itself cut.  Then every row's offset in bytes is its range's offset plus a running sum inside the
range, and its shard is that offset times the number of shards over the total.

Only built-in functions are used; no row meets more rows in one task than its range holds.

Nulls: a null text has size 1 and hashes like any other constant; a null id sorts first.  Identical rows are kept and
are interchangeable.  An empty table gives an empty result.  Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryloom.llm.common import cut

#: Rows that a sample is expected to hold; it bounds what the driver receives.
SAMPLE = 4096
#: Ranges for each shard, and the bytes over which more ranges are made.
RANGES_PER_SHARD = 8
RANGE_BYTES = 256 << 20
#: Ranges are never more than this, whatever the size: the table of ranges stays small on the driver.
MOST_RANGES = 4096
ROUNDS = 6


def _position(splitters: list[tuple[int, int]]) -> F.Column:
    """How many splitters lie at or below the row: a search over blocks of splitters, then within the block."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    pair = lambda p: F.struct(F.lit(p[0]).cast("long").alias("key"), F.lit(p[1]).cast("long").alias("tie"))
    here = F.struct(F.col("key"), F.col("tie"))
    upto = lambda array: F.size(F.filter(array, lambda s: s <= here))
    heads = F.array(*[pair(b[0]) for b in blocks])
    nested = F.array(*[F.array(*[pair(p) for p in b]) for b in blocks])
    block = upto(heads)
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * F.lit(step) + upto(F.element_at(nested, F.greatest(block, F.lit(1)))))


def _sample(rows: DataFrame, weight: F.Column, seed: int) -> list[tuple[int, int]]:
    """Rows drawn with chance `weight`, as sorted (key, tie) pairs; the draw depends on the row and the seed only."""
    u = F.pmod(F.xxhash64(F.col("key"), F.col("tie"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted({(r.key, r.tie) for r in rows.where(u < weight).select("key", "tie").collect()})


def _quantiles(points: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return sorted({points[len(points) * i // parts] for i in range(1, parts)}) if points else []


def shard_by_bytes(
    df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shards: int = 16, sample: int = SAMPLE, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Columns: id, size, text_crc32, shard, slot, range, offset.  Shards differ by one row's size at most; `range` and `offset` say how."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = cut(
        df.select(
            F.col(id_column).alias("id"),
            F.xxhash64(F.col(text_column)).alias("key"),
            F.coalesce(F.col(id_column), F.lit(-(1 << 63))).cast("long").alias("tie"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
    )
    total, = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, -(-total // range_bytes)))
    sample = max(sample, 4 * parts)
    splitters = _quantiles(_sample(rows, F.col("size") * F.lit(sample / max(total, 1)), 0), parts)
    limit = 2 * -(-total // parts)
    for seed in range(1, ROUNDS + 1):
        ranged = rows.withColumn("range", _position(splitters))
        found = {r.range: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
        overfull = {k: r.bytes for k, r in found.items() if r.bytes > limit and r.rows > 1}
        if not overfull or seed == ROUNDS:
            break
        # a sample in which each overfull range is expected to give 16 rows for each part that it needs
        inner = ranged.where(F.col("range").isin(list(overfull)))
        rate = F.element_at(F.create_map(*[F.lit(x) for k, b in overfull.items() for x in (k, 32.0 / limit)]), F.col("range"))
        more = _sample(inner, F.col("size") * rate, seed)
        cuts = sorted(set(splitters) | set(_quantiles(more, 2 * sum(-(-b // limit) for b in overfull.values()))))
        if cuts == splitters:
            break
        splitters = cuts
    ahead, offsets = (0, 0), []
    for k in sorted(found):
        offsets.append((k, *ahead))
        ahead = (ahead[0] + found[k].bytes, ahead[1] + found[k].rows)
    known = F.broadcast(rows.sparkSession.createDataFrame(offsets, "range int, bytes_ahead long, rows_ahead long"))  # MOST_RANGES rows at most
    inside = Window.partitionBy("range").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("running", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside))
        .join(known, "range")
        .withColumn("offset", F.col("bytes_ahead") + F.col("running") - F.col("size"))
        .withColumn("rank", F.col("rows_ahead") + F.col("nth") - 1)
        .withColumn("shard", F.least(F.expr(f"offset * {shards} div {max(total, 1)}"), F.lit(shards - 1)).cast("int"))
    )
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select("id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"), "range", "offset")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law `bytes`."""
    placed = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
