"""A deterministic sharded WARC writer and its reader.

Records are put in ranges of (id, payload digest), each range is sorted and written to files that roll once their
compressed size passes ROLL_BYTES (a record is never cut).  Ranges are cut at byte-weighted quantiles of a sample that
the rows' hashes choose, and their number depends on the bytes alone, so neither the session nor the cluster has a say:
a rerun gives the same files under the same names.  Headers are made anew from the row: record ids are name-based UUIDs
of the payload digest and id, block and payload digests are SHA-1 in base32, and the date is a parameter.  Of records
with equal payloads of at least `least_bytes` bytes the one with the smallest id is a response; the others are revisits
that name it.

Commit: every attempt of a task writes to names of its own under _temporary, and returns a manifest row for each
file.  Spark keeps the rows of the one attempt that succeeded in a pending manifest; files of that manifest are then
moved to their final names, and last the manifest is renamed to _manifest, whose presence makes the archive readable.
A move whose source is gone was done before (a lost executor's moves run again); a file at the final name while the
source is still there is what a run left that never committed, and is replaced.  An archive that is committed is not
written again.  Readers open what the manifest lists, and check each file's digest against it.

Executors write and read through Arrow's file systems, by the URI of the shared folder (local, HDFS or object store).

Nulls: a null payload is empty, a null url too; a record with a null id is a response.  Identical rows: the first is the
response, the others revisit the same id.  An empty table gives an archive without files, and reading it gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.common import cut, fresh_dir

ROLL_BYTES = 16 << 20
LEAST_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
LEVEL = 6
#: Bytes that the reader inflates at once.
CHUNK = 1 << 14
#: Bytes of payload that a range is meant to hold; ranges are no fewer and no more than these (at 100 TB they hold 6 GB each).
RANGE_BYTES = 128 << 20
LEAST_RANGES, MOST_RANGES = 12, 16384
#: Rows of the sample for each range, about.
SAMPLED = 64
#: Parts of a payload's rows where digests are joined, so that one payload's rows do not meet in one task.
SALTS = 16
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, names that are URLs

MANIFEST = "temporary string, final string, records long, bytes long, sha256 string, first_id long, last_id long"
RECORDS = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(ident: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{ident}/{digest}')}>"


def _header(value: str | None) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value or "").strip()


def record(ident: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, gzipped by itself.  refers_to: the id of the response that a revisit repeats."""
    digest, name = base32_sha1(payload), "" if ident is None else str(ident)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(name, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Row-Id: {name}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(str(refers_to), digest)}", f"X-Refers-To-Row: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def _writer(root: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, base = fs.FileSystem.from_uri(root)
        attempt = f"{base}/_temporary/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        done: list[tuple] = []
        part, nth, sink = None, 0, None
        ids: tuple[int | None, int | None] = (None, None)
        size = count = 0
        digest = hashlib.sha256()
        current: tuple = ()
        rep: int | None = None  # the response that the current id and payload have, by their mark

        def close() -> None:
            nonlocal sink, size, count, digest, ids, nth
            if sink is not None:
                sink.close()
                name = f"part-{part:05d}-{nth:05d}.warc.gz"
                done.append((f"{attempt}/{name}", name, count, size, digest.hexdigest(), *ids))
                nth += 1
            sink, size, count, digest, ids = None, 0, 0, hashlib.sha256(), (None, None)

        for batch in batches:
            for at, ident, url, payload, key, mark in zip(*(batch.column(c) for c in ("range", "id", "url", "payload", "digest", "rep")), strict=True):
                at, ident, key, mark = at.as_py(), ident.as_py(), key.as_py(), mark.as_py()
                if (ident, key) != current:
                    current, rep = (ident, key), None
                if mark is not None:
                    rep, own = mark, mark == ident
                    continue
                if at != part:
                    close()
                    part, nth = at, 0
                refers = rep
                if rep is not None and own:  # of identical rows the first is the response
                    refers, own = None, False
                made = record(ident, url.as_py(), (payload.as_py() or "").encode("utf-8", "surrogatepass"), refers)
                if sink is None:
                    if not done:
                        files.create_dir(attempt, recursive=True)
                    sink = files.open_output_stream(f"{attempt}/part-{part:05d}-{nth:05d}.warc.gz", compression=None)
                sink.write(made)
                digest.update(made)
                size, count = size + len(made), count + 1
                ids = (ids[0] if ids[0] is not None else ident, ident)  # they come sorted, nulls first
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["temporary", "final", "records", "bytes", "sha256", "first_id", "last_id"])

    return write


def _mover(root: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        there = lambda path: files.get_file_info(path).type != fs.FileType.NotFound
        for batch in batches:
            for a, name in zip(batch.column("temporary").to_pylist(), batch.column("final").to_pylist(), strict=True):
                b = f"{base}/{name}"
                if there(a) and there(b):
                    files.delete_file(a)
                elif there(a):
                    files.move(a, b)
                elif not there(b):
                    raise FileNotFoundError(a)
            yield batch.select(["final"])

    return move


def _splitters(keys: DataFrame, ranges: int) -> list[tuple[int, str]]:
    """Byte-weighted quantiles of rows that their own hashes choose: the same whatever the session or the partitions."""
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not rows or ranges < 2:
        return []
    chance = F.col("size") * F.lit(ranges * SAMPLED / total)
    u = F.pmod(F.xxhash64("id", "digest", F.lit(1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = sorted({(-(1 << 63) if r.id is None else r.id, r.digest) for r in keys.where(u < chance).select("id", "digest").collect()})
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def _range(splitters: list[tuple[int, str]]) -> F.Column:
    """How many splitters lie at or below the row's (id, digest): a search over blocks of splitters, then in the block."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [[{"i": i, "d": d} for i, d in splitters[k : k + step]] for k in range(0, len(splitters), step)]
    nested = F.from_json(F.lit(json.dumps(blocks)), "array<array<struct<i:long,d:string>>>")
    here = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("i"), F.col("digest").alias("d"))
    upto = lambda points: F.size(F.filter(points, lambda p: p <= here))
    block = upto(F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<struct<i:long,d:string>>"))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * F.lit(step) + upto(F.element_at(nested, F.greatest(block, F.lit(1)))))


def _hadoop(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_archive(df: DataFrame, root: str, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = LEAST_BYTES, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES) -> str:
    """Write the archive to the folder `root` (a URI) and commit it; returns root.  A root that holds an archive is refused."""
    spark = df.sparkSession
    path, system = _hadoop(spark, root)
    if system.exists(path(f"{root}/_manifest")):
        raise FileExistsError(f"{root} holds an archive")
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), F.col(payload_column).alias("payload"))
    text = F.coalesce("payload", F.lit(""))
    # digests alone are sampled, grouped and joined; payloads move once, to their range, where the mark of their id and digest precedes them
    keyed = rows.withColumn("digest", F.sha1(text.cast("binary")))
    keys = cut(keyed.select("id", "digest", (F.octet_length(text) + 400).cast("long").alias("size")))
    reps = keys.where(F.col("size") >= least_bytes + 400).groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1 AND rep IS NOT NULL")
    salted = reps.select("digest", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marks = keys.where("id IS NOT NULL").select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["digest", "salt"]).select("id", "digest", "rep").distinct()
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-int(total) // range_bytes)))
    splitters = _splitters(keys, ranges)
    none = lambda t: F.lit(None).cast(t)
    both = keyed.select("id", "url", "payload", "digest", none("long").alias("rep")).unionByName(marks.select("id", none("string").alias("url"), none("string").alias("payload"), "digest", "rep"))
    ranged = both.withColumn("range", _range(splitters).cast("int"))
    placed = ranged.repartitionById(len(splitters) + 1, "range").sortWithinPartitions("range", F.col("id").asc_nulls_first(), "digest", F.col("rep").asc_nulls_last(), "url")
    pending = f"{root}/_pending-{uuid.uuid4().hex}"
    placed.mapInArrow(_writer(root, roll_bytes), MANIFEST).write.json(f"{pending}/written")
    # the files' folder is named by what they hold: writers of other records use others, and those of the same records the same files
    written = spark.read.schema(MANIFEST).json(f"{pending}/written")
    mark = written.agg(F.sum(F.xxhash64("final", "sha256").cast("decimal(38,0)"))).first()[0] or 0
    folder = f"data-{int(mark) & (1 << 64) - 1:016x}"
    named = written.withColumn("final", F.concat(F.lit(f"{folder}/"), "final"))
    if not system.exists(path(f"{root}/_manifest")):
        system.mkdirs(path(f"{root}/{folder}"))
        named.mapInArrow(_mover(root), "final string").write.mode("overwrite").format("noop").save()
        named.write.json(f"{pending}/manifest")
    if system.exists(path(f"{root}/_manifest")) or not system.rename(path(f"{pending}/manifest"), path(f"{root}/_manifest")):
        raise FileExistsError(f"{root} was committed by another run")
    # what dead runs, and those that come too late, have left
    for left in system.listStatus(path(root)):
        if left.getPath().getName() not in (folder, "_manifest"):
            system.delete(left.getPath(), True)
    return root


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive file, digests checked."""
    import zlib

    at, view = 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        found = []
        while not member.eof and at < len(data):
            found.append(member.decompress(view[at : at + CHUNK]))
            at += min(CHUNK, len(data) - at)
        at -= len(member.unused_data)
        if not member.eof:
            raise ValueError("a record is cut off")
        raw = b"".join(found)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if base32_sha1(block) != fields["WARC-Block-Digest"].removeprefix("sha1:") or payload is not None and base32_sha1(payload) != digest:
            raise ValueError(f"digest mismatch in record {fields['WARC-Record-ID']}")
        number = lambda name: int(fields[name]) if fields.get(name) else None
        yield number("X-Row-Id"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Payload-Length"), digest, number("X-Refers-To-Row"), payload


def _reader(root: str, with_payload: bool):
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        for batch in batches:
            for name, sha in zip(batch.column("final").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                with files.open_input_stream(f"{base}/{name}", compression=None) as source:
                    content = source.read()
                if hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{name} is not the file of the manifest")
                rows: list[tuple] = []
                held = 0
                for row in parse(content):
                    rows.append(row if with_payload else (*row[:-1], None))
                    held += 200 + (row[3] if with_payload else 0)
                    if held > 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    return read


def read_archive(spark: SparkSession, root: str, *, with_payload: bool = True) -> DataFrame:
    """The records of a committed archive: of the files, about ROLL_BYTES each, that its manifest lists."""
    listed = spark.read.schema(MANIFEST).json(f"{root}/_manifest").select("final", "sha256")
    return listed.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_reader(root, with_payload), RECORDS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages to a WARC archive in the shared folder, then read it back."""
    root = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_dir(spark, "warc"))
    return read_archive(spark, root, with_payload=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH keyed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, html, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS INT) + 1, 1) for k in range(32)], '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS rep
  FROM keyed
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = rep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = rep THEN NULL ELSE rep END AS refers_to
FROM coded
"""
