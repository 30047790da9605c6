"""Syntax-aware chunks, class models and field references.

Python sources are parsed by the standard library's `ast`, five other languages by `syntax`; others, and sources that cannot be read, are
chunked as text.  One row in, several out: Arrow batches, as no built-in function parses.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.operators import syntax
from quarryloom.operators.chunking import MOST, OVERLAP
from quarryloom.sources.staging import staged

#: Breaks that str.splitlines knows beyond \n, as the text chunker cuts lines there too.
_CHUNK = [("chunk_ord", pa.int32()), ("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("kind", pa.string()), ("function_name", pa.string()), ("class_name", pa.string()), ("docstring", pa.string()), ("strategy", pa.string())]


def pack_lines(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """The text chunker for a single text: (content, first line, last line)."""
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    first = 1
    for number, line in enumerate(text.splitlines(keepends=True), 1):
        if held and sum(map(len, held)) + len(line) > most:
            out.append(("".join(held), first, number - 1))
            keep, size = 0, 0
            while keep < len(held) and size + len(held[-1 - keep]) <= overlap:
                size += len(held[-1 - keep])
                keep += 1
            held = held[len(held) - keep :]
            first = number - keep
        if len(line) > most:
            at = 0
            while True:
                out.append((line[at : at + most], number, number))
                if at + most >= len(line):
                    break
                at += most - overlap
            held, first = [], number + 1
        else:
            held.append(line)
    if held:
        out.append(("".join(held), first, first + len(held) - 1))
    return out


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])


def _definitions(body: list[ast.stmt], owner: str | None) -> Iterator[tuple[ast.AST, str | None]]:
    """Outermost functions and classes, also within other statements; what a function holds stays part of it."""
    for node in body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            yield node, owner
        else:
            for part in ("body", "orelse", "finalbody"):
                yield from _definitions(getattr(node, part, []) or [], owner)
            for handler in getattr(node, "handlers", []):
                yield from _definitions(handler.body, owner)


def python_rows(source: str) -> list[tuple] | None:
    """Rows of (content, start, end, kind, function, class, docstring, strategy), or None if the source does not parse or defines nothing.

    A class with definitions in it gives its head and then each of them; others are whole.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    lines = source.splitlines(keepends=True)
    span = lambda a, b: "".join(lines[a - 1 : b])
    rows: list[tuple] = []

    def add(node: ast.AST, owner: str | None) -> None:
        start, end = _first_line(node), node.end_lineno
        if isinstance(node, ast.ClassDef):
            inner = list(_definitions(node.body, node.name))
            if inner:
                head_end = max(start, _first_line(inner[0][0]) - 1)
                rows.append((span(start, max(node.lineno, node.body[0].lineno - 1) if node.body[0].lineno > node.lineno else node.lineno).strip(), start, head_end, "class_definition", None, node.name, ast.get_docstring(node), "ast"))
                for child, of in inner:
                    add(child, of)
            else:
                rows.append((span(start, end).strip("\n"), start, end, "class_definition", None, node.name, ast.get_docstring(node), "ast"))
        else:
            rows.append((span(start, end).strip("\n"), start, end, "function_definition", node.name, owner, ast.get_docstring(node), "ast"))

    for node, owner in _definitions(tree.body, None):
        add(node, owner)
    return rows or None


def split_long(rows: list[tuple], most: int = MOST) -> list[tuple]:
    """What is longer than `most` is cut as text, each part with the names of the whole; in order of lines."""
    cut: list[tuple] = []
    for row in rows:
        if len(row[0]) <= most:
            cut.append(row)
        else:
            cut += [(text, row[1] + a - 1, row[1] + b - 1, *row[3:7], "ast_split") for text, a, b in pack_lines(row[0], most, min(OVERLAP, most // 4))]
    return sorted(cut, key=lambda r: (r[1], r[2]))


def python_chunks(source: str, most: int = MOST) -> list[tuple] | None:
    rows = python_rows(source)
    return split_long(rows, most) if rows else None


#: Names of languages as they may come.
ALIASES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "golang": "go", "rs": "rust"}


def source_chunks(source: str | None, language: str | None, most: int = MOST) -> list[tuple]:
    if not source or not source.strip():
        return []
    name = (language or "").strip().lower().removeprefix(".")
    name = ALIASES.get(name, name)
    found = python_rows(source) if name == "python" else syntax.definition_rows(source, name) if name in syntax.LANGUAGES else None
    return split_long(found, most) if found else [(t, a, b, "text", None, None, None, "text") for t, a, b in pack_lines(source, most)]


def chunk_sources(files: DataFrame, *, content: str = "content", language: str = "language", most: int = MOST) -> DataFrame:
    """One row for each chunk: the file's other columns and those of a chunk."""
    own = [f for f in files.schema.fields if f.name not in (content, *[n for n, _ in _CHUNK])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            rows: list[tuple] = []
            for i, (text, name) in enumerate(zip(batch.column(content).to_pylist(), batch.column(language).to_pylist(), strict=True)):
                for k, row in enumerate(source_chunks(text, name, most)):
                    if row[0].strip():
                        index.append(i)
                        rows.append((k, *row))
            kept = batch.select([f.name for f in own]).take(pa.array(index, pa.int64())) if own else None
            made = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_CHUNK)]
            yield pa.RecordBatch.from_arrays([*(kept.columns if own else []), *made], [*[f.name for f in own], *[n for n, _ in _CHUNK]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], "chunk_ord int, content string, start_line int, end_line int, kind string, function_name string, class_name string, docstring string, strategy string"])
    return files.mapInArrow(run, schema)


_NAME = rf"(?!(?:{'|'.join([*keyword.kwlist, '__debug__'])})\b)[A-Za-z_]\w*"
_DOTTED = rf"{_NAME}(?:\.{_NAME})*+"
_VALUE = rf"""(?:(?:None|True|False)\b|{_DOTTED}|(?:0|[1-9][0-9]{{0,8}})\b|"[^"\n]*"|'[^'\n]*')"""
_CALL = rf"{_DOTTED}\((?:{_VALUE}(?:, {_VALUE}(?!=))*+(?:, {_NAME}={_VALUE})*+|{_NAME}={_VALUE}(?:, {_NAME}={_VALUE})*+)?\)"
_SIMPLE = rf"(?:{_NAME}: {_DOTTED}(?: = (?:{_CALL}|{_VALUE}))?|{_NAME} = (?:{_CALL}|{_VALUE})|{_CALL})"
#: Lines one below the other, of one indent, each of which is a statement of a plain form by itself.
_RUN = re.compile(rf"^( *+)(?:{_SIMPLE})$(?:\n\1(?:{_SIMPLE})$)*+", re.M | re.A)
_SET = re.compile(r"^ *(\w+)(:| =)", re.M | re.A)
#: Where lines may not be statements by themselves, or cannot be told to be without more rules: such sources are parsed as they are.
_WOVEN = ('"""', "'''", "\\", "\r", "\t", "\f", "\0")
_FORMATTED = re.compile(r"""[fFtT][rR]?["']|[rR][fFtT]["']""")
_QUOTED = re.compile(r"""\"[^"\n]*"|'[^'\n]*'|#[^\n]*""")


def _parsed(source: str) -> tuple[ast.Module, dict[int, str]]:
    """The source's tree, in which a run of plain statements may be one number; and those runs by their first line.

    A tree costs a hundred times its text, and most lines of models and schemas are of a few plain forms.  A run becomes a
    number and empty lines, if no line begins or ends within brackets or a string; so what does not parse still does not, and all lines keep their numbers.
    """
    if any(w in source for w in _WOVEN):
        return ast.parse(source), {}
    runs: dict[int, str] = {}
    parts, at, line = [], 0, 1
    for m in _RUN.finditer(source):
        between = source[at : m.start()]
        parts.append(between)
        line += between.count("\n")
        below = m[0].count("\n")
        runs[line] = m[0]
        parts.append(m[1] + "0" + "\n" * below)
        line += below
        at = m.end()
    parts.append(source[at:])
    masked = "".join(parts)
    if _FORMATTED.search(masked):
        return ast.parse(source), {}
    for row in filter(None, _QUOTED.sub("", masked).split("\n")):
        if '"' in row or "'" in row or sum(map(row.count, "([{")) != sum(map(row.count, ")]}")):
            return ast.parse(source), {}
    return ast.parse(masked), runs


def _classes(tree: ast.Module) -> Iterator[ast.ClassDef]:
    """All classes, level by level as `ast.walk` comes to them; classes are in statements alone, so expressions are passed over."""
    level: list[ast.AST] = [tree]
    while level:
        below: list[ast.AST] = []
        for node in level:
            if isinstance(node, ast.ClassDef):
                yield node
            for name in node._fields:
                inner = getattr(node, name, None)
                if isinstance(inner, list):
                    below += [x for x in inner if isinstance(x, ast.stmt | ast.excepthandler | ast.match_case)]
        level = below


def class_members(source: str) -> list[tuple[str, str, str, int | None]]:
    """(class, member, kind, line): annotated fields, assigned columns, properties, methods, and what __init__ sets on self.
    A source that does not parse is read line by line."""
    out: dict[tuple[str, str, str], int | None] = {}
    try:
        tree, runs = _parsed(source)
    except (SyntaxError, ValueError):
        return _loose_members(source)
    for cls in _classes(tree):
        put = lambda name, kind, line: out.setdefault((cls.name, name, kind), line)  # noqa: B023, E731
        for item in cls.body:
            match item:
                case ast.Expr(lineno=first) if first in runs:
                    for k, row in enumerate(runs[first].split("\n")):
                        if m := _SET.match(row):
                            out.setdefault((cls.name, m[1], "field" if m[2] == ":" else "column"), first + k)
                case ast.AnnAssign(target=ast.Name(id=name)):
                    put(name, "field", item.lineno)
                case ast.Assign(targets=targets):
                    for name in (t.id for t in targets if isinstance(t, ast.Name)):
                        put(name, "column", item.lineno)
                case ast.FunctionDef(name=name, decorator_list=decorators):
                    put(name, "property" if any(getattr(d, "id", None) == "property" or getattr(d, "attr", None) == "getter" for d in decorators) else "method", item.lineno)
                    if name == "__init__":
                        for node in ast.walk(item):
                            targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
                            for t in targets:
                                if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                                    put(t.attr, "attribute", node.lineno)
    return [(*k, line) for k, line in out.items()]


def _loose_members(source: str) -> list[tuple[str, str, str, int | None]]:
    out, current = [], None
    for number, line in enumerate(source.splitlines(), 1):
        if m := re.match(r"\s*class\s+([A-Za-z_]\w*)", line):
            current = m[1]
        elif current and (m := re.match(r"\s+def\s+([A-Za-z_]\w*)", line)):
            out.append((current, m[1], "method", number))
        elif current and (m := re.match(r"\s+(?:self\.)?([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", line)):
            out.append((current, m[1], "field", number))
    return out


#: Sources that are read at once: their members leave a task in as many parts.
SOURCES = 256


def class_models(chunks: DataFrame, *, key: str, content: str = "content", named: str | None = None) -> DataFrame:
    """Columns: key, class_name, member, kind, line.  With `named`, sources that cannot hold a class of that name, in any case, are not parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SOURCES):
                batch = whole.slice(at, SOURCES)
                rows = [(i, *m) for i, text in enumerate(batch.column("content").to_pylist()) for m in class_members(text or "")]
                kept = batch.column("key").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([kept, *[pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.string()), (4, pa.int32()))]], ["key", "class_name", "member", "kind", "line"])

    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(F.col(key).alias("key"), F.col(content).alias("content"))
    if named is not None and named.isascii():  # other letters may be read as ASCII ones
        rows = rows.where(F.lower("content").contains(named.lower()) | F.col("content").rlike(r"[^\x00-\x7F]"))
    return rows.mapInArrow(run, f"key {kind}, class_name string, member string, kind string, line int").withColumnRenamed("key", key)


#: Arguments that map a field to a name.
MAPPED = ("attribute", "alias", "source")


def schema_references(chunks: DataFrame, *, key: str, content: str = "content", field: str | None = None) -> DataFrame:
    """Columns: key, line, kind, name, target.  Fields mapped to another name, and accesses to a field, by line."""
    # name = call(arguments): the arguments are split, and the last one with one of MAPPED and a quoted word names the target
    lines = chunks.select(key, F.posexplode(F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")).alias("i", "text"))
    may = F.contains("text", F.lit("=")) & F.contains("text", F.lit("(")) & (F.contains("text", F.lit("fields.")) | F.contains("text", F.lit("Field")))
    has = F.lit(False) if field is None else F.contains("text", F.lit(f".{field}"))  # both are cheap, and most lines are neither
    likely = lines.where(may | has).select(key, (F.col("i") + 1).alias("line"), F.trim("text").alias("text"), may.alias("may"), has.alias("has"))

    def mapping(b: Column) -> Column:
        good = (F.startswith(b["call"], F.lit("fields.")) | (b["call"] == "Field")) & b["name"].rlike(r"^\w+$")
        value = lambda a: F.trim(F.substring_index(a, "=", -1))
        named = F.transform(F.filter(b["arguments"], lambda a: F.trim(F.substring_index(a, "=", 1)).isin(*MAPPED) & value(a).rlike(r"^[\"']\w+[\"']$")), value)
        target = F.transform(F.slice(F.reverse(named), 1, 1), lambda t: F.struct(F.lit("mapping").alias("kind"), b["name"].alias("name"), F.substring(t, F.lit(2), F.length(t) - 2).alias("target")))
        return F.when(good, target)

    parts = F.struct(F.trim(F.substring_index("text", "=", 1)).alias("name"), F.trim(F.regexp_extract("text", r"=([^(]*)\(", 1)).alias("call"), F.split(F.regexp_extract("text", r"\(([^)]*)", 1), ",").alias("arguments"))
    none = F.expr("cast(array() as array<struct<kind: string, name: string, target: string>>)")
    found = F.when(F.col("may"), F.coalesce(F.element_at(F.transform(F.array(parts), mapping), 1), none)).otherwise(none)
    if field is not None:
        access = rf"(?<![\p{{L}}\p{{N}}_])([A-Za-z_][A-Za-z0-9_]*)\.{re.escape(field)}(?![\p{{L}}\p{{N}}_])"
        used = F.transform(F.regexp_extract_all("text", F.lit(access), F.lit(1)), lambda x: F.struct(F.lit("field_access").alias("kind"), x.alias("name"), F.lit(field).alias("target")))
        found = F.concat(found, F.when(F.col("has"), used).otherwise(none))
    return likely.select(key, "line", F.explode(found).alias("f")).select(key, "line", "f.kind", "f.name", "f.target")


def contract(models: DataFrame, references: DataFrame, *, key: str, class_name: str, field: str) -> DataFrame:
    """What is wrong between a model and its users for a field, one row: AMBIGUOUS (several classes of the name),
    INSUFFICIENT (no class, or no use), MODEL_FIELD_MISSING, FIELD_MAPPING_MISMATCH (a mapping to an unknown member), WRONG_FIELD_REFERENCE, NONE."""
    m = staged(models.where(F.lower("class_name") == class_name.lower()))
    near = F.col("member").contains(field) | F.lit(field).contains(F.col("member"))
    is_data = ~F.col("kind").isin("method")
    facts = m.agg(F.countDistinct(key, "class_name").alias("classes"), F.coalesce(F.max((F.col("member") == field).cast("int")), F.lit(0)).alias("has"), F.coalesce(F.max(F.when(is_data, near)), F.lit(False)).alias("near"))
    members = m.where(is_data).select(F.col("member").alias("target"), F.lit(True).alias("known")).distinct()
    # counted row by row: neither the members nor the targets are gathered
    mapped = F.col("kind") == "mapping"
    uses = references.join(members, "target", "left").agg(F.count_if((F.col("kind") == "field_access") & (F.col("target") == field)).alias("uses"), F.count_if(mapped).alias("mappings"), F.count_if(mapped & F.col("known").isNull()).alias("strange"))
    issue = (
        F.when(F.col("classes") > 1, "AMBIGUOUS").when((F.col("classes") == 0) | ((F.col("uses") == 0) & (F.col("mappings") == 0)), "INSUFFICIENT")
        .when(F.col("strange") > 0, "FIELD_MAPPING_MISMATCH").when(F.col("has") == 1, "NONE").when(F.col("near"), "WRONG_FIELD_REFERENCE").otherwise("MODEL_FIELD_MISSING")
    )
    return facts.crossJoin(uses).select(F.lit(class_name).alias("class_name"), F.lit(field).alias("field"), issue.alias("issue"), "classes", "uses")


def contract_text(facts: DataFrame) -> DataFrame:
    return facts.withColumn("text", F.concat_ws("\n", F.lit("Verified facts"), F.concat(F.lit("model: "), "class_name"), F.concat(F.lit("field: "), "field"), F.concat(F.lit("uses: "), F.col("uses").cast("string")), F.concat(F.lit("issue: "), "issue")))
