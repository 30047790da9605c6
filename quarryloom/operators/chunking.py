"""Chunking of texts by lines, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST, OVERLAP = 1500, 150
_CHUNK = "struct<content:string,start_line:int,end_line:int>"


def lines_of(text: Column) -> Column:
    """Lines with their breaks; no empty line after the last break."""
    return F.filter(F.split(text, "(?<=\n)", -1), lambda x: x != "")


def text_chunks(text: Column, most: int = MOST, overlap: int = OVERLAP) -> Column:
    """Lines packed greedily into chunks of at most `most` characters, each beginning with the last whole lines (at most
    `overlap` characters) of the one before; a longer line is cut into slices that overlap by as much, and nothing is carried over it."""
    lines = lines_of(F.coalesce(text, F.lit("")))
    none = F.expr("cast(array() as array<string>)")

    def tail(cur: Column) -> Column:
        """The longest run of last lines within the overlap."""
        taken = F.aggregate(
            F.reverse(cur),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open")),
            lambda a, x: F.when(a["open"] & (a["size"] + F.length(x) <= overlap), F.struct((a["n"] + 1).alias("n"), (a["size"] + F.length(x)).alias("size"), F.lit(True).alias("open"))).otherwise(
                F.struct(a["n"].alias("n"), a["size"].alias("size"), F.lit(False).alias("open"))
            ),
        )
        return F.when(taken["n"] > 0, F.slice(cur, -taken["n"], taken["n"])).otherwise(none)

    def state(out: Column, cur: Column, size: Column, start: Column, at: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), size.cast("int").alias("size"), start.cast("int").alias("start"), at.cast("int").alias("at"))

    def chunk(content: Column, a: Column, b: Column) -> Column:
        return F.struct(content.alias("content"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"))

    def flushed(s: Column, line: Column) -> Column:
        carry = tail(s["cur"])
        return F.when(
            (s["size"] + F.length(line) > most) & (F.size(s["cur"]) > 0),
            state(
                F.concat(s["out"], F.array(chunk(F.array_join(s["cur"], ""), s["start"], s["at"]))), carry,
                F.aggregate(carry, F.lit(0), lambda n, x: n + F.length(x)), s["at"] + 1 - F.size(carry), s["at"],
            ),
        ).otherwise(state(s["out"], s["cur"], s["size"], s["start"], s["at"]))

    def packed(s: Column, line: Column) -> Column:
        at, stride = s["at"] + 1, most - overlap
        slices = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(line) - most) / stride).cast("int"))), lambda k: chunk(F.substring(line, k * stride + 1, F.lit(most)), at, at))
        return F.when(F.length(line) > most, state(F.concat(s["out"], slices), none, F.lit(0), at + 1, at)).otherwise(
            state(s["out"], F.concat(s["cur"], F.array(line)), s["size"] + F.length(line), s["start"], at)
        )

    def step(s: Column, line: Column) -> Column:
        return F.element_at(F.transform(F.array(flushed(s, line)), lambda t: packed(t, line)), 1)

    begin = state(F.expr(f"cast(array() as array<{_CHUNK}>)"), none, F.lit(0), F.lit(1), F.lit(0))
    rest = lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(chunk(F.array_join(s["cur"], ""), s["start"], s["at"])))).otherwise(s["out"])
    return F.aggregate(lines, begin, step, rest)


def chunk_files(files: DataFrame, *, content: str = "content", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """One row for each chunk that is not blank: the file's columns but its content, chunk_ord, content, start_line, end_line, chunk_hash."""
    own = [c for c in files.columns if c != content]
    made = files.select(*own, F.posexplode(text_chunks(F.col(content), most, overlap)).alias("chunk_ord", "chunk")).select(*own, "chunk_ord", "chunk.*")
    return made.where(F.length(F.trim(F.translate("content", "\n\t\r", ""))) > 0).withColumn("chunk_hash", F.sha2("content", 256))
