"""Sources of files: directory trees, archives, listings that come as rows."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of an archive.
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES = 10_000, 500 << 20, 50 << 20
#: Bytes of members that leave a task at once.
AT_ONCE = 8 << 20


def local_tree(spark: SparkSession, root: str, *, content: bool = False) -> DataFrame:
    """Columns: file_path (relative, with slashes), size, and content if asked for.  Any store that Spark reads."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + re.escape(bare) + "/+", "")
    return found.select(relative.alias("file_path"), F.col("length").alias("size"), *([F.col("content")] if content else []))


def with_content(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """wanted: file_path.  Content of each, or an error where the file is not there: one missing file does not fail the run."""
    found = local_tree(spark, root, content=True).select("file_path", "content")
    missing = F.col("content").isNull()
    return wanted.join(found, "file_path", "left").select(
        *wanted.columns, F.coalesce("content", F.lit(b"")).alias("content"), F.when(missing, "failed").otherwise("success").alias("fetch_status"), F.when(missing, "not found").alias("fetch_error")
    )


def git_tree(listing: DataFrame) -> DataFrame:
    """listing: path, type, sha, size of a recursive tree listing.  Its blobs; a missing size is zero."""
    return listing.where("type = 'blob'").select(F.col("path").alias("file_path"), F.col("sha").alias("blob_sha"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def is_safe_path(path):
    """No NUL, no backslash, not absolute, no `..` segment."""
    return ~(path.contains("\0") | path.contains("\\") | path.startswith("/") | path.rlike("^[A-Za-z]:") | F.exists(F.split(path, "/"), lambda p: p == ".."))


def _unsafe(name: str) -> bool:
    return "\0" in name or "\\" in name or name.startswith("/") or bool(re.match("^[A-Za-z]:", name)) or ".." in name.split("/")


def archive_entries(data: bytes, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_file_bytes: int = MOST_FILE_BYTES) -> Iterator[tuple[str, int, bytes]]:
    """(path, size, content) of a zip archive, one member at a time.

    No file, too many files, too many bytes in all or an unsafe path is an error before anything is inflated; a file that is
    too large is left out, but counted; one that inflates to more than it says is an error.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = [e for e in z.infolist() if not e.is_dir()]
        if not entries:
            raise ValueError("the archive holds no file")
        if len(entries) > most_files:
            raise ValueError(f"{len(entries)} files in the archive; {most_files} are allowed")
        for e in entries:
            if _unsafe(e.filename):
                raise ValueError(f"unsafe path in the archive: {e.filename!r}")
        if sum(e.file_size for e in entries) > most_bytes:
            raise ValueError(f"the archive holds more than {most_bytes} bytes")
        for e in entries:
            if e.file_size <= most_file_bytes:
                with z.open(e) as member:
                    content = member.read(e.file_size + 1)
                if len(content) != e.file_size:
                    raise ValueError(f"{e.filename!r} has not the size that the archive says")
                yield e.filename, e.file_size, content


MEMBERS = "commit_id string, file_path string, size long, content binary, error string"


def archive_members(archives: DataFrame, *, key: str = "archive", **limits: int) -> DataFrame:
    """archives: key, content.  Columns: key, commit_id, file_path, size, content, error.

    An archive that breaks a rule, is damaged or holds no file gives a row with the error, one whose files are all too large
    gives none; if the damage shows only on
    inflating, earlier members come too, so drop what has an error by key.  Null content is damaged.  Members leave the
    task as they are inflated, a few megabytes at a time; the archive itself must fit in memory.
    """
    from quarryloom.functions.hashing import archive_commit

    kind = archives.schema[key].dataType.simpleString()
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (commit, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for rows in _rows(commit, data):
                    name = pa.array([batch.column(0)[n].as_py()] * len(rows), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([name, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [key, *(c.split()[0] for c in MEMBERS.split(", "))])

    def _rows(commit: str | None, data: bytes | None) -> Iterator[list[tuple]]:
        rows, held = [], 0
        try:
            for path, size, content in archive_entries(data or b"", **limits):
                rows.append((commit, path, size, content, None))
                held += size
                if held >= AT_ONCE:
                    yield rows
                    rows, held = [], 0
        except (ValueError, NotImplementedError, RuntimeError, EOFError, zipfile.BadZipFile, zlib.error) as e:
            rows.append((commit, None, None, None, str(e) or type(e).__name__))
        yield rows

    return archives.select(key, archive_commit(F.col("content")).alias("commit_id"), "content").mapInArrow(members, f"`{key}` {kind}, {MEMBERS}")


def read_archives(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """The members of the archives in a folder, by their names; see archive_members."""
    return archive_members(spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content"), **limits)
