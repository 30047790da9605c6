"""Removal of bytes that repeat, by interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document of smaller id, or further
ahead in the same document.  Strings are judged on the input; matches never cross documents.

Where equal strings meet.  Every window of LENGTH bytes is owned by the leftmost of its GRAM-byte substrings whose hash
is least (its anchor), so equal windows have equal anchors at equal places in them.  A run of windows with one owner is a segment.
  1. Segments are described (hash of the anchor, hash of the segment, place) and dealt by the anchor.  Equal segments
     are united at once, first among the documents of a batch and then in their bucket: all but the earliest go whole.
  2. Of anchors with several different segments, the bytes of one segment each are fetched from the documents.
  3. Segments of the same anchor are concatenated into blocks of bounded size, whole anchors at a time.  In a block, the
     transform is walked breadth first: intervals of suffixes that share a prefix w are extended backwards to those
     of cw, which sets common-prefix values in increasing order, and the walk stops at LENGTH.  Neighbours whose value was
     not set by then share LENGTH bytes; of each such class all windows but the earliest go.
An anchor with more than HOT different segments (a passage in very many documents, each with other words around it)
is dealt again by the content of each of its windows, united within the batch before.  Its bucket is read as a stream:
whenever HELD_ROWS descriptions are held, equal segments are united and those of hot anchors are passed on, so memory
is bounded however hot an anchor is; its descriptions (about fifty bytes each, one a batch for equal segments) do
come to one task.  Segments of one anchor are told apart by a 64-bit hash; the bytes of united ones are not compared.

Text is moved once, by document; the rest that is moved is about thirty bytes for each thirty of the text.

Nulls: a null text is empty, a null id is smaller than any other.  A document is an id and a text: rows with both in
common are one document and have identical results; of different texts under one id, or without one, the text with the
smaller hash (xxhash64) is the earlier document.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.common import fresh_dir
from quarryloom.sources.tables import spread

LENGTH = 100
GRAM = 32
#: Different segments of one anchor that a block may hold.
HOT = 4096
#: Text whose segments are dealt to one bucket, and partitions of buckets at most (or spark.sql.shuffle.partitions, if more).
BUCKET_BYTES = 16 << 20
MOST_PARTS = 1 << 14
#: Descriptions of a bucket that are held before equal ones are united.
HELD_ROWS = 1 << 20
#: Bytes of segments that one transform is made of.
BLOCK = 1 << 18
#: Descriptions that are held before they are packed.
HELD = 1 << 17
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
NULL_ID = -(1 << 63)

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    if not _POWERS:
        for base in (_STEP, _BACK):
            p = np.full(PIECE + 2 * LENGTH, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def segments(raw: np.ndarray, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """For a document's bytes: anchor hash, segment hash, first window, windows after it, place of the anchor in the segment.

    Long documents are worked on in overlapping pieces, which may cut a segment in two; the parts are segments as well.
    """
    powers, inverse = _powers()
    windows = len(raw) - LENGTH + 1
    for at in range(0, max(windows, 0), piece):
        part = raw[at : min(len(raw), at + piece + LENGTH - 1)]
        n = len(part)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[part] * powers[:n], dtype=np.uint64)))
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
        ranked = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # leftmost on ties
        owner = (_least(ranked, LENGTH - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.append(first[1:], len(owner)) - 1
        anchor = owner[first]
        place = anchor - first
        content = (sums[last + LENGTH] - sums[first]) * inverse[first]
        whole = _mix(content + _mix((place * 256 + last - first).astype(np.uint64)))
        yield grams[anchor], whole, first + at, last - first, place


_SHAPE = [("anchor", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("more", "u1"), ("place", "u1")]
_SPAN = [("doc", "<i8"), ("mark", "<i8"), ("start", "<u4"), ("end", "<u4")]


def _pack(shape, columns) -> bytes:
    """Columns one after the other, which compress better than rows."""
    return b"".join(np.ascontiguousarray(c, dtype=t).tobytes() for (_, t), c in zip(shape, columns, strict=True))


def _unpack(shape, blob: bytes) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in shape)
    n, at, out = len(blob) // width, 0, []
    for _, t in shape:
        size = np.dtype(t).itemsize * n
        out.append(np.frombuffer(blob, t, n, at))
        at += size
    return out


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _describer(buckets: int, most: int = HELD, piece: int = PIECE):
    """Batches of documents to packed descriptions by bucket (kind 0) and spans that repeat within the batch (kind 1)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, docs, sizes, held = [], [], [], 0
            for doc, mark, text in zip(batch.column("did"), batch.column("mark"), batch.column("text"), strict=True):
                raw = np.frombuffer(_raw(text.as_py()), np.uint8)
                for part in segments(raw, piece):
                    found.append(part)
                    docs.append((doc.as_py(), mark.as_py()))
                    sizes.append(len(part[0]))
                    held += len(part[0])
                if held > most:
                    yield united(found, docs, sizes)
                    found, docs, sizes, held = [], [], [], 0
            if found:
                yield united(found, docs, sizes)

    def united(found, docs, sizes) -> pa.RecordBatch:
        anchor, whole, start, more, place = (np.concatenate([f[k] for f in found]) for k in range(5))
        doc, mark = np.repeat(np.array(docs, np.int64).reshape(-1, 2), sizes, 0).T
        order = np.lexsort((start, mark, doc, whole, anchor))
        anchor, whole, doc, mark, start, more, place = (x[order] for x in (anchor, whole, doc, mark, start, more, place))
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])))
        again = np.flatnonzero(_later(new, doc, mark, start))
        keep = np.flatnonzero(new)
        bucket = (anchor[keep] % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        keep, bucket = keep[by], bucket[by]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        kinds, names, blobs = [], [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
            i = keep[a:b]
            kinds.append(0)
            names.append(int(bucket[a]))
            blobs.append(_pack(_SHAPE, (anchor[i], whole[i], doc[i], mark[i], start[i], more[i], place[i])))
        if len(again):
            kinds.append(1)
            names.append(int(docs[0][1] % buckets))
            blobs.append(_pack(_SPAN, _merged(doc[again], mark[again], start[again], start[again] + more[again] + LENGTH)))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

    return describe


def _later(new: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of rows sorted by group and place: those that come after the group's first place, not at it."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[head]) | (mark != mark[head]) | (start != start[head])


def _merged(doc, mark, start, end) -> tuple[np.ndarray, ...]:
    """Spans of documents, united where they overlap or touch."""
    doc, mark, start, end = (np.asarray(x, np.int64) for x in (doc, mark, start, end))
    if not len(doc):
        return doc, mark, start, end
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = (x[order] for x in (doc, mark, start, end))
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))
    base = (np.cumsum(other) - 1) << 40  # ends so far, by document
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate(([True], base[1:] + start[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return doc[new], mark[new], start[new], reach[last] - base[last]


FOUND = "did long, mark long, start long, end long, anchor long, hot boolean, place int"


def _found(did, mark, start, end, anchor=None, hot=None, place=None) -> pa.RecordBatch:
    n = len(did)
    none = lambda t: pa.nulls(n, t)
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array(np.asarray(x, np.int64)) for x in (did, mark, start, end)],
            none(pa.int64()) if anchor is None else pa.array(np.asarray(anchor).astype(np.int64)),
            none(pa.bool_()) if hot is None else pa.array(hot),
            none(pa.int32()) if place is None else pa.array(np.asarray(place, np.int32)),
        ],
        ["did", "mark", "start", "end", "anchor", "hot", "place"],
    )


def _unite(batches: Iterator[pa.RecordBatch], most_kinds: int = HOT, held_rows: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket.  Gives spans that go, and segments whose bytes are needed."""
    held: list[list[np.ndarray]] = []
    rows, most, bucket = 0, held_rows, None
    hot = np.zeros(0, np.uint64)  # anchors of this bucket whose segments were passed on already

    def settle(last: bool) -> Iterator[pa.RecordBatch]:
        """Unites equal segments; what stays held are the first segments of anchors that are not hot."""
        nonlocal held, rows, most, hot
        anchor, whole, doc, mark, start, more, place = (np.concatenate([c[k] for c in held]) for k in range(7))
        held, rows, most = [], 0, held_rows
        if last:  # an anchor's only segment has no equal
            order = np.argsort(anchor)
            edge = anchor[order][1:] != anchor[order][:-1]
            several = np.concatenate(([False], ~edge)) | np.concatenate((~edge, [False])) | np.isin(anchor[order], hot)
            pick = order[several]
            anchor, whole, doc, mark, start, more, place = (x[pick] for x in (anchor, whole, doc, mark, start, more, place))
        if not len(anchor):
            return
        start, more = start.astype(np.int64), more.astype(np.int64)
        order = np.lexsort((start, mark, doc, whole, anchor))
        anchor, whole, doc, mark, start, more, place = (x[order] for x in (anchor, whole, doc, mark, start, more, place))
        fresh = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        new = fresh | np.concatenate(([True], whole[1:] != whole[:-1]))
        again = _later(new, doc, mark, start)
        yield _found(*_merged(doc[again], mark[again], start[again], start[again] + more[again] + LENGTH))
        kinds = np.bincount(np.cumsum(fresh) - 1, new)[np.cumsum(fresh) - 1]
        warm = (kinds > most_kinds) | np.isin(anchor, hot)
        need = new & (warm | (kinds > 1) if last else warm)
        yield _found(doc[need], mark[need], start[need], start[need] + more[need] + LENGTH, anchor[need], warm[need], place[need])
        if not last:
            hot = np.union1d(hot, anchor[warm])
            stay = new & ~warm
            held = [[x[stay] for x in (anchor, whole, doc, mark, start, more, place)]]
            rows = int(stay.sum())
            most = max(held_rows, 2 * rows)

    for batch in batches:
        for name, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            if kind == 1:
                yield _found(*_unpack(_SPAN, blob.as_py()))
                continue
            if name != bucket:
                if held:
                    yield from settle(True)
                held, rows, most, bucket, hot = [], 0, held_rows, name, np.zeros(0, np.uint64)
            held.append(_unpack(_SHAPE, blob.as_py()))
            rows += len(held[-1][0])
            if rows >= most:
                yield from settle(False)
    if held:
        yield from settle(True)


CUTS = "task long, did long, mark long, start long, end long, bytes binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments' bytes, keyed by anchor; of hot anchors each window's, keyed by its content, the first of the batch only."""
    from xxhash import xxh64_intdigest

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for batch in batches:
        rows: list[tuple] = []
        again: list[tuple[int, int, int, int]] = []
        windows: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        size = 0

        def made() -> pa.RecordBatch:
            rows.extend((key, d, m, j, j + LENGTH, window) for (key, window), (d, m, j) in windows.items())
            if again:
                rows.extend((None, *map(int, span), None) for span in zip(*_merged(*zip(*again, strict=True)), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.int64()] * 5, pa.binary()))], ["task", "did", "mark", "start", "end", "bytes"])

        for did, mark, text, wanted in zip(batch.column("did").to_pylist(), batch.column("mark").to_pylist(), batch.column("text"), batch.column("wanted"), strict=True):
            raw = _raw(text.as_py())
            for w in wanted.as_py():
                start, end = w["start"], w["end"]
                if not w["hot"]:
                    rows.append((w["anchor"], did, mark, start, end, raw[start:end]))
                    size += end - start
                    continue
                for j in range(start, end - LENGTH + 1):
                    window, here = raw[j : j + LENGTH], (did, mark, j)
                    key = (signed(xxh64_intdigest(window, (w["anchor"] + w["place"] + start - j) & 0xFFFFFFFFFFFFFFFF)), window)
                    before = windows.get(key)
                    if before is None or here < before:
                        windows[key] = here
                        if before is not None:
                            again.append((*before, before[2] + LENGTH))
                    elif here != before:
                        again.append((*here, j + LENGTH))
            if size > 2 << 20 or len(windows) > 20_000 or len(rows) + len(again) > 50_000:
                yield made()
                rows, again, windows, size = [], [], {}, 0
        yield made()


def suffixes(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Suffixes (of symbols below 512) sorted by their first `length` symbols, by doubling prefixes; ties by place."""
    n = len(text)
    h = 7
    packed = np.zeros(n + h, np.int64)
    wide = np.concatenate((text.astype(np.int64), np.zeros(2 * h, np.int64)))
    for j in range(h):
        packed = (packed << 9) | wide[j : j + n + h]
    key = packed[:n]
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], (s[1:] != s[:-1]).astype(np.int64))))
        if h >= length or rank[order[-1]] == n:
            return order
        step = min(h, length - h)
        follow = np.zeros(n, np.int64)
        if step < n:
            follow[: n - step] = rank[step:]
        key = (rank << 32) | follow
        h += step


def repeats(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it a class: suffixes of a class, and they alone, share their first `length` symbols.

    Common-prefix values are set in increasing order.  An interval of suffixes with prefix w is extended backwards by
    each symbol c before them; if the value at the right end of the interval of cw is not set yet it is the length of w,
    and the interval lives on, else it is dropped.  After `length` rounds the values that are not set are at least `length`.
    """
    text = np.append(text + 1, 0).astype(np.int16)  # ended by a symbol of its own, so that a step back from the first suffix is one as well
    order = suffixes(text, length)
    n = len(order)
    before = text[order - 1]
    by = np.argsort(before, kind="stable")
    forward = np.empty(n, np.int64)
    forward[by] = np.arange(n)  # where the suffix one symbol longer stands
    same = before[by][1:] == before[by][:-1]
    following, preceding = np.full(n, n), np.full(n, -1)  # the next and the last place with this symbol before it
    following[by[:-1][same]] = by[1:][same]
    preceding[by[1:][same]] = by[:-1][same]
    known = np.zeros(n + 1, bool)
    known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(low - (ends - size), size)
        # the intervals of the extensions are disjoint, so sorted left ends and sorted right ends belong together
        left = np.sort(forward[place[preceding[place] < np.repeat(low, size)]])
        right = np.sort(forward[place[following[place] >= np.repeat(high, size)]]) + 1
        new = ~known[right]
        low, high = left[new], right[new]
        known[high] = True
        if not len(low):
            break
    kind = np.cumsum(np.concatenate(([True], known[1:n]))) - 1
    return order[1:], kind[1:]  # the end stands first


def _expand(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by task; whole tasks are put in one block up to about `most` bytes."""
    block: list[tuple[int, int, int, bytes]] = []
    group: list[tuple[int, int, int, bytes]] = []
    task, size = None, 0

    def done() -> pa.RecordBatch:
        doc, mark, start = (np.array([b[k] for b in block], np.int64) for k in range(3))
        lengths = np.array([len(b[3]) for b in block], np.int64)
        heads = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int((lengths + 1).sum()), np.int16)  # 0 parts segments
        inside = np.ones(len(text), bool)
        inside[heads + lengths] = False
        text[inside] = np.frombuffer(b"".join(b[3] for b in block), np.uint8).astype(np.int16) + 1
        order, kind = repeats(text)
        of = np.repeat(np.arange(len(block)), lengths + 1)
        offset = np.arange(len(text)) - heads[of]
        owned = offset <= lengths[of] - LENGTH
        mine = owned[order]
        order, kind = order[mine], kind[mine]
        d, m, s = doc[of[order]], mark[of[order]], start[of[order]] + offset[order]
        by = np.lexsort((s, m, d, kind))
        order, kind, d, m, s = order[by], kind[by], d[by], m[by], s[by]
        later = _later(np.concatenate(([True], kind[1:] != kind[:-1])), d, m, s)
        gone = np.zeros(len(text), bool)
        gone[order[later]] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        a, b = edges[::2], edges[1::2]  # windows after another; a separator lies between segments
        return spans(doc[of[a]], mark[of[a]], start[of[a]] + offset[a], start[of[a]] + offset[b - 1] + LENGTH)

    def spans(d, m, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(d, m, a, b)], ["did", "mark", "start", "end"])

    passed: list[tuple[int, int, int, int]] = []
    for batch in batches:
        for name, did, mark, start, end, raw in zip(*(batch.column(c).to_pylist() for c in ("task", "did", "mark", "start", "end", "bytes")), strict=True):
            if raw is None:
                passed.append((did, mark, start, end))
                continue
            if name != task:
                if len(group) > 1:  # a segment alone has no equal
                    block += group
                    size += sum(len(g[3]) + 1 for g in group)
                    if size >= most:
                        yield done()
                        block, size = [], 0
                task, group = name, []
            group.append((did, mark, start, raw))
        if passed:
            yield spans(*zip(*passed, strict=True))
            passed = []
    if len(group) > 1:
        block += group
    if block:
        yield done()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for did, text, spans in zip(batch.column("did"), batch.column("text"), batch.column("spans"), strict=True):
            raw = _raw(text.as_py())
            n, out, kept, at = len(raw), [], [], 0
            for s in sorted((s["start"], min(s["end"], n)) for s in spans.as_py() or []):
                if out and s[0] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], s[1])
                elif s[0] < s[1]:
                    out.append([*s])
            for a, b in out:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append((did.as_py(), n, sum(b - a for a, b in out), len(out), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in out]))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, block: int = BLOCK, held: int = HELD, held_rows: int = HELD_ROWS, piece: int = PIECE) -> DataFrame:
    """Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of byte spans, end exclusive)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("mark"), F.col(text_column).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, -(-int(total) // bucket_bytes))
    described = rows.mapInArrow(_describer(buckets, held, piece), "bucket int, kind int, blob binary")
    dealt = described.repartition(min(buckets, max(parts, MOST_PARTS)), "bucket").sortWithinPartitions("bucket")
    where = fresh_dir(spark, "segments")
    dealt.mapInArrow(lambda batches: _unite(batches, hot, held_rows), FOUND).write.parquet(where)
    found = spark.read.schema(FOUND).parquet(where)
    wanted = found.where("anchor is not null").groupBy("did", "mark").agg(F.collect_list(F.struct("start", "end", "anchor", "hot", "place")).alias("wanted"))
    # both joins read this one exchange
    texts = rows.repartition(parts, "did", "mark")
    fetched = texts.join(wanted.hint("shuffle_hash"), ["did", "mark"]).mapInArrow(_fetch, CUTS)
    tasks = fetched.repartition(parts, F.coalesce("task", F.xxhash64("did", "mark", "start"))).sortWithinPartitions("task", "did", "mark", "start")
    gone = tasks.mapInArrow(lambda batches: _expand(batches, block), "did long, mark long, start long, end long").unionByName(found.where("anchor is null").select("did", "mark", "start", "end"))
    spans = gone.groupBy("did", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kept = texts.join(spans.hint("shuffle_hash"), ["did", "mark"], "left").mapInArrow(_kept, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    return kept.withColumn("doc_id", F.when(F.col("did") != NULL_ID, F.col("did"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """All documents, at LENGTH bytes."""
    return remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))).drop("removed")


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM d)),
firsts AS (SELECT w, min({'d': doc_id, 'i': i}) AS f FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE {'d': doc_id, 'i': i} > f),
runs AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM gone)),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY ALL),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || any_value(substr(h, CAST(2 * last + 1 AS BIGINT))) AS k
  FROM gaps JOIN d USING (doc_id) JOIN (SELECT doc_id, max(b) AS last FROM spans GROUP BY 1) USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
