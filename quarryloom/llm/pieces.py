"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Machines are compiled from the model file and composed with each input, lazily:
  normaliser   the model's table of character sequences (longest match first; user-defined pieces pass unchanged),
               blanks joined if the model says so, a blank before the text if it says so, spaces to the blank U+2581;
  lexicon      a trie of arcs by character; where a piece ends, an arc back to its root that writes the piece and weighs
               its negative score; a character that no piece is alone has a dearer path, through its UTF-8 bytes' pieces
               or, in models without them, the unknown piece;
  adjacency    for merge-based (BPE) models, in place of the scores: a state for each piece; the arc from piece a to piece
               b weighs 0 if the model's own merges leave "ab" cut between a and b, and infinity otherwise.
The encoding is the shortest path in the tropical semiring.  For a unigram model it is the path of the least sum of
weights, found by relaxing the trie's arcs from every position; on ties the piece that starts first stays.  A BPE
model's segmentation is the one sequence whose neighbours are all left apart by the merges, so the only path of finite
weight is exactly it, and as a prefix's best path is unique too, the search keeps one state for each position.
User-defined pieces are left alone by a BPE model's merges; in a unigram model they weigh what the format gives them.

Where no piece has a blank after another character or holds a line break, which is checked, inputs are cut before
blanks and line breaks without changing any path, and cut parts that were met before are looked up.

The model is read on the driver from a path that is a parameter, and its bytes are sent to the executors.  Word and
character models, and BPE models with unused pieces, are refused.

Nulls: a null text has null ids from `encode`; the query counts it as empty.  An empty text has no pieces.  A text that
itself holds U+2581 is decoded with a space in its place, as in any such model.  Repeated rows are each encoded.  Other columns
are ignored by the query and kept by `encode`, which replaces a column of the name it writes.
"""

from __future__ import annotations

import hashlib
import math
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.sources.tables import spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Parts of inputs in a generation (two are remembered, and parts met again move to the younger), and pairs of pieces that are remembered.
REMEMBERED = 200_000
#: Characters of texts whose new parts are searched together.
GROUP = 2_000_000
#: Longer parts are not remembered.
LONGEST = 48

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
_UNIGRAM, _BPE = 1, 2  # model types
#: What an unknown character costs beyond the dearest piece, and what a user-defined piece gains for each byte but its first.
UNKNOWN_COST, USER_GAIN = 10.0, 0.1


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Normaliser:
    """The machine compiled from a model's table: a double array over bytes, whose leaves point into a list of replacements."""

    def __init__(self, table: bytes, own: list[str], prefix: bool, squeeze: bool):
        size = struct.unpack("<I", table[:4])[0] if table else 0
        self.units = struct.unpack(f"<{size // 4}I", table[4 : 4 + size]) if table else ()
        self.out = table[4 + size :]
        self.own = sorted(own, key=len, reverse=True)
        self.heads = {n[0] for n in own}
        self.prefix, self.squeeze = prefix, squeeze
        self.identity = not (self.units or own or squeeze)

    def _longest(self, raw: bytes, at: int) -> tuple[int, int]:
        """End and leaf of the longest entry that begins here; (at, -1) without one."""
        units, found = self.units, (at, -1)
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(raw)):
            node ^= raw[k]
            unit = units[node]
            if unit & 0x800000FF != raw[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (k + 1, units[node] & 0x7FFFFFFF)
        return found

    def _arcs(self, text: str) -> Iterator[str]:
        """The text as the table's arcs write it, arc by arc."""
        at = 0
        while at < len(text):
            mine = next((n for n in self.own if text.startswith(n, at)), None) if text[at] in self.heads else None
            if mine is not None:
                yield mine
                at += len(mine)
                continue
            if self.units:
                raw = text[at : at + 64].encode("utf-8", "surrogatepass")
                end, leaf = self._longest(raw, 0)
                if leaf >= 0:
                    yield self.out[leaf : self.out.index(b"\0", leaf)].decode()
                    at += len(raw[:end].decode("utf-8", "surrogatepass"))
                    continue
            yield text[at]
            at += 1

    def apply(self, text: str) -> str:
        if self.identity:
            return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)
        made: list[str] = []
        spaced = self.squeeze  # whether blanks at the start of what comes next go
        for part in self._arcs(text):
            if spaced:
                part = part.lstrip(" ")
            if part:
                made.append(part)
                spaced = self.squeeze and part.endswith(" ")
        whole = "".join(made).replace(" ", BLANK)
        if self.squeeze:
            whole = whole.rstrip(BLANK)
        return (BLANK if self.prefix and whole else "") + whole


class Transducer:
    def __init__(self, model: bytes):
        self.names: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        kind, prefix, squeeze, table = _UNIGRAM, True, True, b""
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.names.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, _NORMAL))
            elif field == 2:
                spec = dict(_fields(value))
                kind = spec.get(3, _UNIGRAM)
                if kind not in (_UNIGRAM, _BPE) or spec.get(24):
                    raise ValueError("word and character models, and blanks as suffixes, are not supported")
            elif field == 3:
                spec = dict(_fields(value))
                prefix, squeeze, table = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
                if not spec.get(5, 1):
                    raise ValueError("models that keep spaces are not supported")
        self.unigram = kind == _UNIGRAM
        if not self.unigram and _UNUSED in kinds:
            raise ValueError("merge-based models with unused pieces are not supported")
        typed = lambda *wanted: {n: i for i, (n, k) in enumerate(zip(self.names, kinds, strict=True)) if k in wanted}
        self.ids, self.users = typed(_NORMAL), typed(_USER)
        self.normaliser = Normaliser(table, list(self.users), prefix, squeeze)
        self.prefix = prefix
        self.unknown = kinds.index(_UNKNOWN)
        bytes_ = {int(n[1:-1], 16): i for n, i in typed(_BYTE).items()}
        self.bytes = [bytes_.get(b, self.unknown) for b in range(256)] if bytes_ else None
        self.raw = [bytes([int(n[1:-1], 16)]) if k == _BYTE else n.replace(BLANK, " ").encode() if k in (_NORMAL, _USER, _UNUSED) else " \u2047 ".encode() if k == _UNKNOWN else b"" for n, k in zip(self.names, kinds, strict=True)]
        self.cuts = self.bytes is not None and not any(BLANK in n.lstrip(BLANK) or "\n" in n for n in (*self.ids, *self.users))
        self.apart: dict[int, bool] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.unigram:
            self._lexicon()
            return
        # a piece that the merges never make is on no path
        self.alive = {n: i for n, i in self.ids.items() if self.merged(n) == [n]}
        # lengths of pieces of three characters or more by their last three, longest first
        tails: dict[str, set[int]] = {}
        for n in self.alive:
            if len(n) > 2:
                tails.setdefault(n[-3:], set()).add(len(n))
        self.tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}

    def _lexicon(self) -> None:
        """Arcs of the trie (a table of next states by character for each state), and pieces that end at a state, with their weights."""
        scores = [self.scores[i] for i in self.ids.values()] or [0.0]
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float] | None] = [None]
        for n, i in (*self.ids.items(), *self.users.items()):
            state = 0
            for c in n:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                state = self.arcs[state][c]
            self.ends[state] = (i, -USER_GAIN * (len(n.encode()) - 1) if n in self.users else -self.scores[i])
        self.strange = UNKNOWN_COST - min(scores)

    def lightest(self, texts: list[str]) -> Iterator[list[int]]:
        """For each normalised text the path of least weight through the lexicon."""
        arcs, ends, root = self.arcs, self.ends, self.arcs[0]
        for text in texts:
            n = len(text)
            weight, back, last = [math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
            weight[0] = 0.0
            for at in range(n):
                here, alone = weight[at], False
                state, k = root.get(text[at]), at + 1
                while state is not None:
                    end = ends[state]
                    if end is not None:
                        alone |= k == at + 1
                        if here + end[1] < weight[k]:
                            weight[k], back[k], last[k] = here + end[1], at, end[0]
                    state, k = arcs[state].get(text[k]) if k < n else None, k + 1
                if not alone and here + self.strange < weight[at + 1]:
                    weight[at + 1], back[at + 1], last[at + 1] = here + self.strange, at, -1
            yield self._written(text, last, back)

    def _written(self, text: str, last: list[int], back: list[int]) -> list[int]:
        """The ids on the path that ends at the text's end; -1 stands for a character that is no piece."""
        out: list[int] = []
        at, strange = len(text), False
        while at:
            piece, start = last[at], back[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes is not None:
                out.extend(self.bytes[b] for b in reversed(text[start:at].encode("utf-8", "surrogatepass")))
            elif not strange:  # a run of unknown characters is one piece
                out.append(self.unknown)
            strange = piece < 0
            at = start
        out.reverse()
        return out

    def merged(self, text: str) -> list[str]:
        """What the model's merges make of a short string: the best-scored pair of neighbours first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, a: int, b: int) -> bool:
        """Whether the adjacency arc from a to b has finite weight."""
        key = a << 32 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            x, y = self.names[a], self.names[b]
            known = self.apart[key] = self.merged(x + y) == [x, y]
        return known

    def paths(self, texts: list[str]) -> Iterator[list[int]]:
        """For each normalised text the path of finite weight through its composition: one arc kept for each position.

        A text that begins as the one before it keeps the search's states up to there, so sorted texts are cheapest.
        """
        last = [-1]  # the piece that ends here; -1: the start, or a character spelled in bytes; -2: nothing does
        back = [0]
        alive, apart, tails, ids = self.alive, self.apart, self.tails, self.ids
        previous = ""
        for text in texts:
            n = len(text)
            common = 0
            for x, y in zip(text, previous, strict=False):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], back[common + 1 :]
            for end in range(common + 1, n + 1):
                best, start = -2, 0
                for length in (*tails.get(text[end - 3 : end], ()), 2, 1) if end > 2 else (2, 1) if end == 2 else (1,):
                    at = end - length
                    if at < 0:
                        continue
                    before = last[at]
                    if before == -2:
                        continue
                    piece = alive.get(text[at:end])
                    if piece is None:
                        continue
                    if before >= 0:
                        fits = apart.get(before << 32 | piece)
                        if not (self.weight(before, piece) if fits is None else fits):
                            continue
                    best, start = piece, at
                    break
                if best == -2 and text[end - 1] not in ids:
                    best, start = -1, end - 1
                last.append(best)
                back.append(start)
            previous = text
            yield self._written(text, last, back)

    def shortest(self, text: str) -> list[int]:
        """The best path of one normalised text; around user-defined pieces, which merges leave alone, it is put together from parts."""
        if self.unigram:
            return next(self.lightest([text]))
        if not self.users:
            return next(self.paths([text]))
        out: list[int] = []
        at = start = 0
        while at <= len(text):
            mine = next((n for n in self.normaliser.own if text.startswith(n, at)), None) if at < len(text) else ""
            if mine is None:
                at += 1
                continue
            if start < at:
                found = next(self.paths([text[start:at]]))
                out += found[1:] if self.bytes is None and out and out[-1] == self.unknown == found[0] else found
            if not mine:
                break
            out.append(self.users[mine])
            at = start = at + len(mine)
        return out

    def _cut(self, text: str) -> list[str]:
        """The text's parts: '\n' begins a part without a blank before it; other parts have one blank left off."""
        words = text.replace("\n", " \n").split(" ")
        if "" not in words:
            return words
        joined: list[str] = []
        blanks = 0  # each adds one to the part after it
        for w in words:
            if w == "":
                blanks += 1
            elif w[0] == "\n":
                if blanks:
                    joined.append(BLANK * (blanks - 1))
                joined.append(w)
                blanks = 0
            else:
                joined.append(BLANK * blanks + w)
                blanks = 0
        if blanks:
            joined.append(BLANK * (blanks - 1))
        return joined

    def _learn(self, fresh: set[str]) -> None:
        ordered = sorted(fresh)
        whole = [w if w.startswith("\n") else BLANK + w for w in ordered]
        for w, ids in zip(ordered, (self.lightest if self.unigram else self.paths)(whole), strict=True):
            self.parts[w] = array("i", ids).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if not (self.cuts and self.prefix and self.normaliser.identity):
            return [np.array(self.shortest(self.normaliser.apply(t)) if t else [], np.int32) for t in texts]
        cut = [None if BLANK in t else self._cut(t) if t else [] for t in texts]
        if len(self.parts) > REMEMBERED:
            self.parts, self.older = {}, self.parts
        fresh: set[str] = set()
        for c in cut:
            fresh |= set(c or ()).difference(self.parts)
        again = fresh.intersection(self.older)
        self.parts.update((w, self.older[w]) for w in again)
        fresh -= again
        self._learn(fresh)
        known = self.parts.__getitem__
        out = [np.frombuffer(b"".join(map(known, c)), np.int32) if c is not None else np.array(self.shortest(BLANK + t.replace(" ", BLANK)), np.int32) for t, c in zip(texts, cut, strict=True)]
        for w in [w for w in fresh if len(w) > LONGEST]:
            del self.parts[w]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_MADE: dict[bytes, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """Compiled once in each worker."""
    key = hashlib.sha256(model).digest()
    if key not in _MADE:
        _MADE[key] = Transducer(model)
    return _MADE[key]


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in groups of about GROUP characters."""
    group: list[str | None] = []
    size = 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def _model(df: DataFrame, path: str):
    with open(path, "rb") as file:  # on the driver; half a megabyte
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, *, text_column: str = "text", ids_column: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with a column of piece ids (array of int)."""
    held = _model(df, model)
    fields = [f for f in df.schema.fields if f.name != ids_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(held.value)
        for batch in batches:
            texts = batch.column(text_column).to_pylist()
            made = [None if t is None else x for group in _groups(texts) for t, x in zip(group, machine.encode_all([t or "" for t in group]), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(made, pa.list_(pa.int32()))], [*[f.name for f in fields], ids_column])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(ids_column, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, *, ids_column: str = "ids", text_column: str = "text", model: str = MODEL) -> DataFrame:
    """The rows with the text of their piece ids."""
    held = _model(df, model)
    fields = [f for f in df.schema.fields if f.name != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(held.value)
        for batch in batches:
            made = [None if x.as_py() is None else machine.decode(x.as_py()) for x in batch.column(ids_column)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(made, pa.string())], [*[f.name for f in fields], text_column])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(text_column, T.StringType())]))


def summarise(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Columns: doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip, and ids if asked for."""
    held = _model(docs, model)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(held.value)
        for batch in batches:
            at = 0
            for group in _groups(batch.column("text").to_pylist()):
                some = batch.slice(at, len(group))
                at += len(group)
                texts = [t or "" for t in group]
                ids = machine.encode_all(texts)
                columns = [
                    some.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                    pa.array([machine.decode(x) == t.replace(BLANK, " ") for x, t in zip(ids, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_pieces", "ids_sha256", "round_trip"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again."""
    return summarise(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
