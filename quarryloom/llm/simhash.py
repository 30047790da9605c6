"""SimHash near-duplicates: fingerprints, a binary trie self-join under a Hamming budget, and components.

Fingerprints are made where the texts lie.  Equal fingerprints become one node at once, so a group of copies of any
size is a single node from there on.  Two fingerprints that differ in at most BUDGET bits agree in at least BLOCKS -
BUDGET of BLOCKS bit blocks; for each choice of so many blocks, nodes are dealt by their bits there, and every bucket
is a subtree of the trie whose bits are ordered with the chosen blocks first.  In a bucket, pairs of trie nodes are
walked down together from (root, root), differing bits are added up, and a pair is given up when they exceed the
budget.  A bucket of more than BUCKET fingerprints is dealt again by further bits into cells, and each pair of
cells is a task of its own, so that no bucket, however hot, meets in one task.  A task returns a spanning forest of
its links (at most one less than its nodes), which has the same components.  Components come from min-label star
contraction over the forests, with a checkpoint in the shared folder each round.

Nulls: a null text, as an empty one, has no words and fingerprint zero, and is linked like any other.  A null id is
kept, with its component (ids of components are the smallest non-null id).  Repeated rows are returned each.  An empty
table gives none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.common import cut, filed, join_hot
from quarryloom.sources.tables import spread

SHINGLE = 3
BUDGET = 3
BLOCKS = 5
SEED = 42
#: Fingerprints of a bucket that one task joins; larger buckets are split into cells of about half as many.
BUCKET = 2048
#: Rows of whole tasks that are joined at once.
ROWS = 50_000
#: Shingles whose bits are counted at once.
PIECE = 1 << 16
#: Words of a shingle where documents are compared by similarity (`similar_documents`).
STAGE_SHINGLE = 5
#: One in so many documents, by hash, is in the sample that orders keys by frequency; shingles that it names, at most.
SHARE, COMMON = 8, 200_000
#: Edges of a task where components are made, and tasks at least.
EDGES, LEAST_TASKS = 100_000, 8

_BOUNDS = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    if len(words) <= shingle:
        digests = [xxh64_digest(b" ".join(words), SEED)]
        ones += np.unpackbits(np.frombuffer(digests[0], np.uint8))
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        for at in range(0, n, PIECE):
            pairs = zip(starts[at : min(n, at + PIECE)].tolist(), ends[at + shingle - 1 : min(n, at + PIECE) + shingle - 1].tolist(), strict=True)
            bits = np.unpackbits(np.frombuffer(b"".join([xxh64_digest(line[a:b], SEED) for a, b in pairs]), np.uint8))
            # counts of up to 255 rows fit a byte, and bytes add fast
            bits = bits.reshape(-1, 64)
            whole = len(bits) // 255 * 255
            ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) if whole else 0
            ones += bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns: doc_id, fp (the 64 bits as a signed long)."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def trie_links(keys: np.ndarray, roots: np.ndarray | None = None, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a uint64 array that differ in at most `budget` bits.

    roots: rows (a0, a1, b0, b1), each a pair of runs of the array, to be joined with each other or, if they are the same
    run, with itself; a run is sorted, and distinct.  Without roots the whole array is one run.  A trie node at a depth is a
    part [lo, hi) of a run whose keys share so many first bits.  All live pairs of nodes go down a bit together; where
    both are single leaves, their remaining bits are compared at once.
    """
    if roots is None:
        roots = np.array([[0, len(keys), 0, len(keys)]])
    a0, a1, b0, b1 = roots[(roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3])].T
    errors = np.zeros(len(a0), np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for bit in range(63, -1, -1):
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            i, j = a0[leaves], b0[leaves]
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i < j)
            out.append((i[near], j[near]))
            a0, a1, b0, b1, errors = (x[~leaves] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            break
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the node's 1s of this bit begin
        parts = []
        for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            live = (x0 < x1) & (y0 < y1) & (errors + more <= budget) & (x0 <= y0)  # the mirror of a pair is not walked
            parts.append((x0[live], x1[live], y0[live], y1[live], errors[live] + more))
        a0, a1, b0, b1, errors = (np.concatenate(p) for p in zip(*parts, strict=True))
    live = a0 < b0
    out.append((a0[live], b0[live]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches, by pointer jumping."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def _rotated(fp: F.Column, blocks: tuple[int, ...]) -> F.Column:
    """The bits of the chosen blocks."""
    mask = sum(((1 << (_BOUNDS[b + 1] - _BOUNDS[b])) - 1) << (64 - _BOUNDS[b + 1]) for b in blocks)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def join_tasks(task: np.ndarray, side: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (child, root) of whole tasks' links; side 1 marks the rows of a task's second cell."""
    order = np.lexsort((fp, side, task))
    task, side, fp = task[order], side[order], fp[order]
    heads = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
    ends = np.append(heads[1:], len(task))
    first = ends - np.add.reduceat(side, heads)  # where the second cell begins
    one = first == ends
    roots = np.stack([heads, first, np.where(one, heads, first), ends], 1)
    i, j = trie_links(fp, roots, budget)
    label = forest(len(fp), i, j)
    child = np.flatnonzero(label != np.arange(len(fp)))
    return fp[child], fp[label[child]]


def _joiner(budget: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by task; whole tasks are joined together, about ROWS rows at once."""
        held: list[np.ndarray] = []
        rows = 0

        def made(x: np.ndarray) -> pa.RecordBatch:
            child, root = join_tasks(x[0], x[1], x[2].astype(np.uint64), budget)
            return pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), pa.array(root.astype(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("task", "side", "fp")]))
            rows += batch.num_rows
            if rows >= ROWS:
                x = np.concatenate(held, 1)
                cut_at = int(np.searchsorted(x[0], x[0, -1]))
                if cut_at:
                    yield made(x[:, :cut_at])
                held, rows = [x[:, cut_at:]], x.shape[1] - cut_at
        if held and rows:
            yield made(np.concatenate(held, 1))

    return join


def links(nodes: DataFrame, *, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Columns a, b: forests whose components are those of all pairs of distinct fp at `budget` bits or fewer."""
    choices = list(combinations(range(BLOCKS), BLOCKS - budget))
    keyed = nodes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), _rotated(F.col("fp"), c).alias("bits")) for k, c in enumerate(choices)])).alias("at"),
    ).select("fp", F.xxhash64("at.choice", "at.bits").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = keyed.join(sizes, "bucket").withColumn("cells", F.when(F.col("n") <= bucket, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / bucket)).cast("int"))
    # a fingerprint of cell c meets cell c alone, and every other cell d once: as the first cell if c < d
    celled = found.withColumn("cell", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cells")).cast("int"))
    dealt = celled.select("fp", "bucket", "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    tasks = dealt.select(
        F.xxhash64("bucket", F.least("cell", "other"), F.greatest("cell", "other")).alias("task"),
        (F.col("cell") > F.col("other")).cast("int").alias("side"),
        "fp",
    )
    # a number of partitions is given, as rows are few bytes but much work, and would be coalesced
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_joiner(budget), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root: for each node of an edge, one node of its component, by alternating large and small stars."""
    pairs = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())

    def measure(p: DataFrame) -> tuple:
        return tuple(p.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = measure(pairs)
    # every task of a shuffle writes files, so few edges lie in few tasks, as many as their number asks for
    tasks = max(LEAST_TASKS, -(-state[0] // EDGES))
    while state[0]:
        pairs = pairs.coalesce(tasks)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").coalesce(tasks).distinct().coalesce(tasks)
        lowest = large.groupBy("v").agg(F.min("u").alias("m")).coalesce(tasks)
        small = large.join(lowest, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").coalesce(tasks).distinct()
        pairs = cut(small.coalesce(tasks))
        after = measure(pairs)
        if after == state:
            break
        state = after
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", budget: int = BUDGET) -> DataFrame:
    """Columns: doc_id, fp, component_id (the smallest id of its component)."""
    prints = cut(fingerprints(docs, id_column=id_column, text_column=text_column))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = components(links(nodes.select("fp"), budget=budget))
    rooted = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    named = join_hot(rooted, rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m")), "root", "m").select("fp", "component_id", "n")
    return join_hot(prints, cut(named), "fp", "n").select("doc_id", "fp", "component_id")


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, sorted; a shorter text is one shingle, and one without words has none."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts, ends = [0, *ends[: max(0, len(words) - shingle)]], ends[min(len(words), shingle) - 1 :]
    made = b"".join([xxh64_digest(line[a : b - 1], SEED) for a, b in zip(starts, ends, strict=True)])
    return np.unique(np.frombuffer(made, ">u8").astype(np.uint64))


#: Keys that similar sets of many shingles share at least.
SHARED = 4
#: Nodes of a key above which they meet in a group, and are not listed in pairs.
HOT = 24
#: Nodes and shingles of a group that one task compares; bits of a sketch.
CELL, HELD, SKETCH = 1024, 2_000_000, 4096
#: Bits of a bitmap for each text that is looked for, and bits at most.
SPARE, MOST_BITS = 16, 1 << 28


def _least_shared(size):
    """How many of their keys two similar sets, of which the smaller has this size, share at least."""
    return np.minimum(1 + size // 16, SHARED)


def shingle_prints(docs: DataFrame, *, shingle: int = STAGE_SHINGLE, common: np.ndarray | None = None) -> DataFrame:
    """docs: doc_id, text, mark.  Columns: doc_id, mark, node (equal sets of shingles have one), fp (of the set), size, keys.

    keys are a set's first shingles in one order for all sets, those of `common` (sorted by frequency) last.  They are so
    many that two sets of similarity 4/5 or more share `_least_shared` of them.
    """
    order = np.argsort(common) if common is not None and len(common) else None
    known = common[order] if order is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            nodes, fps, sizes, keys = [], [], [], []
            for t in batch.column("text"):
                x = hashes(t.as_py(), shingle)
                n = len(x)
                ones = sum((np.unpackbits(x[at : at + PIECE].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64) for at in range(0, n, PIECE)), np.zeros(64, np.int64))
                fps.append(int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big"))
                nodes.append(xxh64_intdigest(x.tobytes(), SEED))
                sizes.append(n)
                if known is not None and n:
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    # the most frequent ones have the lowest place in `common`, and come last
                    x = x[np.argsort(np.where(known[at] == x, len(known) - order[at], 0), kind="stable")]
                keys.append(x[: n - (4 * n + 4) // 5 + int(_least_shared(n))] if n else x)
            longs = [pa.array(np.array(c, np.uint64).astype(np.int64)) for c in (nodes, fps, sizes)]
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *longs, lists], ["doc_id", "mark", "node", "fp", "size", "keys"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark string, node long, fp long, size long, keys array<long>")


def common_shingles(docs: DataFrame, *, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Shingles that recur in a sample, the most frequent first.  They only set the order of keys: any order finds the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0, np.uint64), *(hashes(t.as_py(), shingle) for t in batch.column("text"))])
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["h"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SHARE)) == 0).select("text")
    found = cut(drawn.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"))
    # the least count of which no more than COMMON shingles are, from the numbers of each count
    least, named = 0, 0
    for r in sorted(found.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect(), key=lambda r: -r.n):
        named += r.m
        if named > COMMON:
            break
        least = r.n
    rows = found.where(F.col("n") >= least).toPandas().sort_values(["n", "h"], ascending=[False, True]) if least else None
    return rows.h.to_numpy(np.int64).astype(np.uint64) if rows is not None else np.zeros(0, np.uint64)


#: Pairs of rows of whole tasks that are looked at together.
PAIRS = 1 << 19


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, node, at, root) come sorted by task.  Gives the pairs of a task that may reach 4/5."""
    held: list[np.ndarray] = []
    waiting = 0

    def made(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        task = x[0]
        heads = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
        ends = np.repeat(np.append(heads[1:], len(task)), np.diff(np.append(heads, len(task))))
        after = ends - np.arange(len(task)) - 1  # rows of the task that follow
        crossed = np.maximum.reduceat(x[1], heads).repeat(np.diff(np.append(heads, len(task))))  # of two cells: pairs across only
        at, upto = 0, np.cumsum(after)
        while at < len(task):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            n = after[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            at = to
            side, size, place, root = x[1], x[3] >> 32, x[3] & 0xFFFFFFFF, x[4]
            can = ((side[i] != side[j]) | (crossed[i] == 0)) & (root[i] != root[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j]))
            i, j = i[can], j[can]
            # what a pair can share is no more than the keys before this one and what follows; it must hold for the first SHARED
            can = 9 * (np.minimum(size[i] - place[i], size[j] - place[j]) + SHARED - 1) >= 4 * (size[i] + size[j])
            i, j = i[can], j[can]
            a, b = x[2][i], x[2][j]
            need = _least_shared(np.minimum(size[i], size[j]))
            both, count = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b), need)), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, both), pa.array(count)], ["a", "b", "need", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        root = pc.coalesce(batch.column("root"), batch.column("node"))
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (*(batch.column(n) for n in ("task", "side", "node", "at")), root)]))
        waiting += batch.num_rows
        if waiting >= ROWS:
            x = np.concatenate(held, 1)
            whole = int(np.searchsorted(x[0], x[0, -1]))
            if whole:
                yield from made(x[:, :whole])
            held, waiting = [x[:, whole:]], x.shape[1] - whole
    if held and waiting:
        yield from made(np.concatenate(held, 1))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows (key, node, at) of keys that several nodes have, with n, the number of their nodes."""
    return keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")


def sharing(shared: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """shared: key, node, at (size and place of the key, in one number), root (null where it is the node itself), n.
    Columns a, b: distinct pairs of different roots that share as many keys as similar sets do and may reach 4/5 by size and place.

    A key of more than `bucket` nodes is dealt into cells, and each pair of cells is a task of its own.
    """
    found = shared.withColumn("cells", F.when(F.col("n") <= bucket, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / bucket)).cast("int"))
    celled = found.withColumn("cell", F.pmod(F.xxhash64("node", F.lit(1)), F.col("cells")).cast("int"))
    dealt = celled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    tasks = dealt.select(F.xxhash64("key", F.least("cell", "other"), F.greatest("cell", "other")).alias("task"), (F.col("cell") > F.col("other")).cast("int").alias("side"), "node", "at", "root")
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tasks.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_paired, "a long, b long, need long, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """For each of SKETCH buckets whether it has an odd number of hashes: two sketches differ in no more bits than their sets in hashes."""
    return np.packbits((np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).view(np.uint64)


def united(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A forest of pairs of similarity 4/5 or more, which joins all rows of different roots that such pairs join; of two sides, pairs across only.

    Similar sets differ in a ninth of their sizes' sum at most; sketches that differ in more bits are passed over, others are compared whole.
    """
    size = np.array([len(x) for x in sets])
    sketch = np.stack([odd_sketch(x) for x in sets])
    label = np.unique(root, return_inverse=True)[1]
    crossed, out = bool(side.any()), []
    for i in range(len(sets) - 1):
        can = (label[i + 1 :] != label[i]) & (5 * np.minimum(size[i], size[i + 1 :]) >= 4 * np.maximum(size[i], size[i + 1 :]))
        if crossed:
            can &= side[i + 1 :] != side[i]
        j = np.flatnonzero(can) + i + 1
        j = j[9 * np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64) <= size[i] + size[j]]
        for k in j.tolist():
            if label[k] != label[i]:
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 9 * both >= 4 * (size[i] + size[k]):
                    out.append((i, k))
                    label[label == label[k]] = label[i]
    return out


def _united(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (task, side, node, root, text) come sorted by task; one task's sets are held."""
        task, rows = None, []

        def made() -> pa.RecordBatch:
            nodes = np.array([r[1] for r in rows], np.int64)
            pairs = united([r[3] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[0] for r in rows])) if len(rows) > 1 else []
            at = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[at[:, 0]]), pa.array(nodes[at[:, 1]])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "side", "node", "root")]
            for t, side, node, root, text in zip(*columns, batch.column("text"), strict=True):
                if t != task:
                    if rows:
                        yield made()
                    task, rows = t, []
                rows.append((side, node, root, hashes(text.as_py(), shingle)))
        if rows:
            yield made()

    return run


def named_rows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, and at most a few in a hundred others: a bitmap of the wanted keys' hashes is broadcast, so that the rows need not move.

    It has SPARE bits for each wanted key, MOST_BITS (32 MB) at most; with more keys more others stay, none is lost.
    """
    n = wanted.count()
    bits = min(MOST_BITS, 1 << max(15, (SPARE * n).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1  # the functions on bitmaps count from 1
    marks = wanted.select(F.bitmap_bucket_number(place).alias("_of"), F.bitmap_bit_position(place).alias("_at")).groupBy("_of").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    bit = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)) & 1")
    found = rows.withColumn("_of", F.bitmap_bucket_number(place)).withColumn("_at", F.bitmap_bit_position(place)).join(F.broadcast(marks), "_of")
    return found.where(bit == 1).drop("_of", "_at", "_bits")


def unite(groups: DataFrame, nodes: DataFrame, docs: DataFrame, *, shingle: int = STAGE_SHINGLE, cell: int = CELL, most: int = HELD) -> DataFrame:
    """groups: group, node.  nodes: node, mark, size, root.  Columns a, b: forests that join what pairs of similarity 4/5 or more within a group join.

    A group of more than `cell` nodes, or `most` shingles, is dealt into cells, and each pair of cells is a task of its own, to which
    each text goes once: pairs are neither listed nor moved.
    """
    members = cut(groups.distinct().join(nodes.drop("mark"), "node"))
    facts = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("root").alias("low"), F.max("root").alias("high"))
    share = F.greatest(F.col("n") * 2 / cell, F.col("total") * 2 / most)
    apart = cut(facts.where("low < high").select("group", "n", F.when((F.col("n") <= cell) & (F.col("total") <= most), F.lit(1)).otherwise(F.ceil(share)).cast("int").alias("cells")))
    celled = join_hot(members, apart, "group", "n").withColumn("cell", F.pmod(F.xxhash64("node", F.lit(1)), F.col("cells")).cast("int"))
    dealt = celled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    tasks = dealt.select(F.xxhash64("group", F.least("cell", "other"), F.greatest("cell", "other")).alias("task"), (F.col("cell") > F.col("other")).cast("int").alias("side"), "node", "root")
    wanted = filed(members.join(apart.select("group"), "group", "left_semi").select("node").distinct().join(nodes.select("node", "mark"), "node"))
    # of a text one row is kept before it meets its tasks, by the same exchange
    texts = named_rows(docs.select("mark", "text"), wanted, "mark").groupBy("mark").agg(F.first("text").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(tasks.join(wanted, "node").join(texts, "mark").select("task", "side", "node", "root", "text").repartition(parts, "task").sortWithinPartitions("task").mapInArrow(_united(shingle), "a long, b long"))


def similar_documents(docs: DataFrame, *, shingle: int = STAGE_SHINGLE, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """Columns: doc_id, mark (MD5 of the text, a null one as empty), root.  Components of all pairs whose sets of shingles have a Jaccard similarity of 4/5 or more.

    Groups in which similar sets meet: first components of fingerprints within the error budget, each compared by its sets.  Then, of sets
    that are still apart, every similar pair shares some of its keys.  If one of them is a key of more than `hot` nodes, both are in the
    group of that key's hub (the component of one node of the key, so that the many keys of one large group make few groups); if none is, the
    pair shares so many of the other keys that it is counted as a candidate, and components of candidates are groups.  So no pair is lost.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("mark"))
    prints = cut(shingle_prints(docs, shingle=shingle, common=common_shingles(docs, shingle=shingle)).withColumn("row", F.monotonically_increasing_id()))
    nodes = cut(prints.groupBy("node").agg(F.min("mark").alias("mark"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.min("row").alias("first"), F.count(F.lit(1)).alias("n")))

    def rooted(roots: DataFrame) -> DataFrame:
        return nodes.select("node", "mark", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    prints_of = nodes.join(components(links(nodes.select("fp").distinct())).withColumnRenamed("node", "fp"), "fp", "left")
    close = unite(prints_of.select(F.coalesce("root", "fp").alias("group"), "node"), nodes.select("node", "mark", "size", F.col("node").alias("root")), docs, shingle=shingle, cell=cell)
    known = filed(rooted(components(close)))

    # of rows with equal sets the first one gives the keys; only the nodes of several rows are named, so that keys are not grouped
    sets = prints.join(filed(nodes.where("n > 1").select("node", "first")), "node", "left").where("first is null or first = row")
    placed = sets.select("node", "size", F.posexplode("keys").alias("place", "key"))
    shared = cut(shared_keys(placed.select("key", "node", (F.shiftleft("size", 32) + F.col("place")).alias("at"))))
    many = shared.where(F.col("n") > hot).select("key", "node")
    hubs = filed(many.groupBy("key").agg(F.max(F.struct(F.xxhash64("node").alias("rank"), "node")).alias("hub"), F.count(F.lit(1)).alias("n")).select("key", F.col("hub.node").alias("node"), "n").join(known.select("node", F.col("root").alias("group")), "node").drop("node"))
    few = shared.where(F.col("n") <= hot).join(known.select("node", F.nullif("root", "node").alias("root")), "node", "left")
    candidates = components(sharing(few, bucket=hot))
    groups = join_hot(many, hubs, "key", "n").select("group", "node").unionByName(candidates.select(F.col("root").alias("group"), "node")).unionByName(candidates.select(F.col("root").alias("group"), F.col("root").alias("node")))
    more = unite(groups, known, docs, shingle=shingle, cell=cell)
    found = components(close.unionByName(more))
    named = cut(nodes.join(found, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")))
    return join_hot(prints.select("doc_id", "mark", "node"), named, "node", "n").select("doc_id", "mark", "root")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents; fingerprints link at BUDGET or fewer differing bits."""
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
