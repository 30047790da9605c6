"""Chroma fingerprints of audio, and the alignment of recordings by them.

Samples are cut into overlapping frames; a frame's power is added up by pitch class, smoothed over time and scaled to length one.
Over the image of frames by pitch classes, sixteen box filters (differences of two areas, read off an integral image)
are evaluated at every frame; the logarithm of the two areas' ratio is quantised to two Gray-coded bits each, so that a
frame becomes a packed 32-bit integer.

Alignment.  A recording's keys are its runs of packed integers (shortened, repeats left out) with their place: every run
of RUN, and, as those are shared by chance in a large corpus, runs of LONG_RUN, of which those with the least hash among
LONG_WINDOW neighbours are taken and which count as two.  Any two recordings that share a key are compared: votes for each
difference of places make an offset histogram, and at its peak, if it has VOTES votes or the two overlap by less than FEW
integers there, the differing bits of the overlapping integers are counted.  Pairs with at most ERRORS of the bits
differing over at least OVERLAP integers are links; classes are their components.  (Unrelated recordings differ in about
three bits of ten; over fewer integers than OVERLAP some come under ERRORS by chance.)  Equal fingerprints are one node
from the start.

Fingerprints are written once, by cells of their hash, and each pair of cells is a task of its own that reads them from the
shared folder by blocks of about CELL bytes, of each cell one at a time, and makes the keys, histograms and comparisons of
its pairs, a few recordings at once; so a task's memory is bounded, no pair and no fingerprint moves, and no key, however
many recordings share it, is cut short.  A comparison ends as soon as it has too many errors.  Of each pair of blocks a task
returns a row for each recording that has links there: their number, its best one and its root in a forest of them.  Bytes
read, and comparisons of keys that are shared by chance, grow with the square of the recordings.

The tables at hand hold no audio, so the query renders each turn of `conversations` as a melody, a tone for each
word; `fingerprint` itself takes WAV bytes, or any loader of samples.

Nulls: null media, and media without a sample, are each a class of their own; media too short for an integer have
a class with those of the same samples; media that can't be read raise an error.  Repeated rows are each returned.
Rows with null ids are kept and are the smallest.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import io
import itertools
import math
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.common import cut, filed, fresh_dir, join_hot
from quarryloom.sources.tables import spread

RATE = 4000
FRAME, STEP = 1024, 341
LOWEST, HIGHEST = 55.0, 1760.0
SMOOTHING = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDEST = 16
LEVELS = (-0.25, 0.0, 0.25)
#: A key is this many integers in a row, each without its last DROPPED bits (those of the last filters): copies that begin
#: between two frames differ in some bits of most integers, and share few exact ones.
RUN, DROPPED = 2, 8
LONG_RUN, LONG_WINDOW = 6, 8
ERRORS, OVERLAP = 0.15, 24
#: Keys that must agree on an offset before bits are compared there, but for overlaps of under FEW integers, where one will do.
VOTES, FEW = 2, 64
#: Frames transformed at once; frames packed together, if a recording has no more.
BLOCK, TOGETHER = 64, 4096
#: Bytes of a block, with APIECE more for each recording; cells at least.
CELL, APIECE, CELLS = 16 << 20, 256, 6
#: Shared keys of pairs, and integers of pairs, that a task looks at together.
PAIRS, COMPARED = 1 << 18, 1 << 22

#: Kind, first pitch class, pitch classes, frames.  1: halves by pitch, 2: halves by time, 3: quarters crosswise, 4: thirds by pitch, 5: thirds by time.
FILTERS = [(kind := 1 + k % 5, 5 * k % 7, 3 if kind == 4 else 3 + k % 3, (6, 9, 12, 15)[k % 4] if kind == 5 else (4, 8, 12, 16)[k % 4]) for k in range(16)]


def wav_samples(data: bytes | None) -> np.ndarray:
    """Samples of a 16-bit WAV file, its channels averaged, at RATE (linearly interpolated)."""
    if not data:
        return np.zeros(0)
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("16-bit samples are expected")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1)
        rate = w.getframerate()
    return x if rate == RATE or not len(x) else np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)


_TONE = 500


def _tones() -> np.ndarray:
    t = np.arange(_TONE) / RATE
    fade = np.minimum(1, np.minimum(np.arange(_TONE), np.arange(_TONE)[::-1]) / 40)
    return np.stack([8000 * fade * np.sin(2 * np.pi * 110 * 2 ** (k / 12) * t) for k in range(36)]).astype(np.float32)


_MADE: list[np.ndarray] = []


def melody(text: str | None) -> np.ndarray:
    """A tone for each word, its pitch chosen by the word's checksum."""
    if not _MADE:
        _MADE.append(_tones())
    pitch = [zlib.crc32(w) % 36 for w in (text or "").encode("utf-8", "surrogatepass").split()]
    return _MADE[0][pitch].ravel() if pitch else np.zeros(0)


def _classes() -> np.ndarray:
    """Which bins belong to which pitch class."""
    frequency = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(frequency), 12), np.float32)
    inside = (frequency >= LOWEST) & (frequency <= HIGHEST)
    out[inside, np.round(12 * np.log2(frequency[inside] / LOWEST)).astype(int) % 12] = 1
    return out


_WINDOW = np.hanning(FRAME).astype(np.float32)
#: The bins of all pitch classes, from the first to the last; each row twice, for the squares of the real and the imaginary part.
_FIRST, _LATER = (lambda b: (int(b[0]), int(b[-1]) + 1))(np.flatnonzero(_classes().any(1)))
_BINS = np.repeat(_classes()[_FIRST:_LATER], 2, axis=0)
_ROOM: list[tuple[np.ndarray, np.ndarray]] = []


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by twelve pitch classes."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float32), FRAME)[::STEP]
    if len(frames) < len(SMOOTHING):
        return np.zeros((0, 12))
    if not _ROOM:
        _ROOM.append((np.empty((BLOCK, FRAME), np.float32), np.empty((BLOCK, FRAME // 2 + 1), np.complex64)))
    shaped, spectrum = _ROOM[0]
    image = np.empty((len(frames), 12))
    for i in range(0, len(frames), BLOCK):
        n = min(BLOCK, len(frames) - i)
        np.multiply(frames[i : i + n], _WINDOW, out=shaped[:n])
        np.fft.rfft(shaped[:n], out=spectrum[:n])
        parts = spectrum[:n].view(np.float32)[:, 2 * _FIRST : 2 * _LATER]
        image[i : i + n] = np.square(parts, out=parts) @ _BINS
    image = sum(w * image[i : len(image) - len(SMOOTHING) + 1 + i] for i, w in enumerate(SMOOTHING))
    return image / np.maximum(np.sqrt((image**2).sum(1, keepdims=True)), 1e-9)


def packed(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each frame that has WIDEST frames from it on."""
    return packed_all([image])[0]


#: The logarithm of a ratio reaches a level where the ratio reaches this.
_RATIOS = tuple(math.exp(x) for x in LEVELS)


def packed_all(images: list[np.ndarray]) -> list[np.ndarray]:
    """The same of several, whose sums lie one after another; each image has its own."""
    size = [len(x) for x in images]
    total = np.zeros((sum(size) + len(size) + WIDEST, 13))
    begin = [at + k for k, at in enumerate(itertools.accumulate(size, initial=0))]
    for at, image in zip(begin, images, strict=False):
        np.cumsum(image, 0, out=total[at + 1 : at + 1 + len(image), 1:])
    np.cumsum(total[:, 1:], 1, out=total[:, 1:])
    total = np.ascontiguousarray(total.T)
    n = total.shape[1] - WIDEST

    def area(t: int, y: int, width: int, height: int) -> np.ndarray:
        up, low = total[y + height], total[y]
        return up[t + width : t + width + n] - up[t : t + n] - low[t + width : t + width + n] + low[t : t + n]

    out = np.zeros(n, np.uint32)
    for kind, y, height, width in FILTERS:
        whole = area(0, y, width, height)
        if kind == 1:
            part = area(0, y, width, height // 2)
        elif kind == 2:
            part = area(0, y, width // 2, height)
        elif kind == 3:
            h, w = height // 2, width // 2
            part = area(0, y, w, h) + area(w, y + h, width - w, height - h)
        elif kind == 4:
            part = area(0, y + height // 3, width, height // 3)
        else:
            part = area(width // 3, y, width // 3, height)
        rest = 1e-3 + whole - part
        part += 1e-3
        low, middle, high = (part >= r * rest for r in _RATIOS)
        # levels 0 to 3 as 0, 1, 3, 2
        out <<= np.uint32(1)
        out |= middle
        out <<= np.uint32(1)
        out |= low ^ high
    return [out[at : at + max(0, k - WIDEST + 1)] for at, k in zip(begin, size, strict=False)]


def fingerprint(df: DataFrame, *, first_id: str, second_id: str, media_column: str, load: Callable[[object], np.ndarray] = wav_samples) -> DataFrame:
    """Columns: a, b (the row's two ids), fp (packed integers as little-endian bytes), mark (hash of the samples; null without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            made, marks, images, frames = [], [], [], 0
            for m in batch.column("media"):
                samples = np.ascontiguousarray(load(m.as_py()), np.float32)
                images.append(chroma(samples))
                marks.append(xxh64_intdigest(samples) >> 1 if len(samples) else None)
                frames += len(images[-1])
                if frames >= TOGETHER:
                    made += [x.astype("<u4").tobytes() for x in packed_all(images)]
                    images, frames = [], 0
            made += [x.astype("<u4").tobytes() for x in packed_all(images)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(made, pa.binary()), pa.array(marks, pa.int64())], ["a", "b", "fp", "mark"])

    return df.select(F.col(first_id).cast("long").alias("a"), F.col(second_id).cast("long").alias("b"), F.col(media_column).alias("media")).mapInArrow(run, "a long, b long, fp binary, mark long")


def recording_keys(line: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of recordings of so many packed integers each, one after another in a line: recordings, keys, their first places, and their votes, by recording."""
    rec, key, place, votes, _ = _keys(line, size)
    return rec, key, place, votes


def _keys(line: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same, and the order by key and recording."""
    of, begin = np.repeat(np.arange(len(size), dtype=np.int32), size), np.cumsum(size) - size
    v = line >> np.uint32(DROPPED)
    at = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (of[1:] != of[:-1])))) if len(v) else np.zeros(0, int)
    v, of = v[at].astype(np.uint64), of[at]
    place = (at - begin[of]).astype(np.int32)
    out = [(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int8))]
    for run, window, votes in ((RUN, 1, 1), (LONG_RUN, LONG_WINDOW, 2)):
        if len(v) < run:
            continue
        whole = np.flatnonzero(of[: len(of) - run + 1] == of[run - 1 :])  # runs that do not leave their recording
        h = np.full(len(v) - run + 1, run, np.uint64)
        for j in range(run):
            h ^= v[j : j + len(h)]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h, rec, first = h[whole], of[whole], place[whole]
        if window > 1 and len(h) >= window:
            n = len(h) - window + 1
            inside = np.flatnonzero(rec[:n] == rec[window - 1 :])
            least, step = h[:n].copy(), np.zeros(n, np.int8)
            for j in range(1, window):
                less = h[j : j + n] < least
                np.copyto(least, h[j : j + n], where=less)
                step[less] = j
            kept = np.bincount(rec, minlength=len(size))[rec] <= window
            kept[inside + step[inside]] = True
            h, rec, first = h[kept], rec[kept], first[kept]
        out.append((rec, h, first, np.full(len(h), votes, np.int8)))
    rec, h, place, votes = (np.concatenate(c) for c in zip(*out, strict=True))
    by_rec = np.argsort(rec, kind="stable")  # two runs that are merged
    rec, h, place, votes = rec[by_rec], h[by_rec], place[by_rec], votes[by_rec]
    order = _order(h)
    key, of = h[order], rec[order]
    kept = np.ones(len(h), bool)
    kept[order[1:][(key[1:] == key[:-1]) & (of[1:] == of[:-1])]] = False  # a key's later places in the recording
    order = order[kept[order]]
    order = (np.cumsum(kept) - 1)[order]
    return rec[kept], h[kept].view(np.int64), place[kept], votes[kept], order


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit keys."""
    low = np.uint64((1 << len(key).bit_length()) - 1)
    # leading bits and the place in one number, which sorts fast; not if two keys differ in their last bits only
    x = (key & ~low) | np.arange(len(key), dtype=np.uint64)
    x.sort()
    order = (x & low).astype(np.int64)
    head, ranked = x & ~low, key[order]
    if ((head[1:] == head[:-1]) & (ranked[1:] != ranked[:-1])).any():
        return np.argsort(key, kind="stable")
    return order


def differing(x: bytes, y: bytes, offset: int) -> tuple[int, int]:
    """Differing bits, and integers compared, where x at i + offset meets y at i."""
    a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    start, end = max(0, -offset), min(len(b), len(a) - offset)
    if end <= start:
        return 0, 0
    return int(np.bitwise_count(a[start + offset : end + offset] ^ b[start:end]).sum()), end - start


class Side:
    """Recordings with their keys, those by recording and those by key."""

    def __init__(self, node: np.ndarray, fps: list[bytes]):
        self.node, self.size = node, np.array([len(f) // 4 for f in fps], np.int64)
        ints = np.frombuffer(b"".join(fps), "<u4")
        self.base = np.cumsum(self.size) - self.size
        # room for a window of AT_ONCE integers at every place
        self.line = np.concatenate((ints, np.zeros(AT_ONCE, np.uint32))).astype(np.uint32)
        # by recording: recording, key's place in it, and votes; and by key: recording and place
        self.rec, key, self.place, self.votes, order = _keys(ints, self.size)
        self.rec_by_key, self.place_by_key, ranked = self.rec[order], self.place[order], key.view(np.uint64)[order]
        heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, int)
        self.key, self.starts = ranked[heads], np.append(heads, len(ranked)).astype(np.int32)
        # of the keys by recording: their place by key, and which of the distinct keys they are
        self.rank, self.which = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.which[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(self.starts))

    def windows(self) -> np.ndarray:
        return np.ndarray((len(self.line) - AT_ONCE + 1,), f"V{4 * AT_ONCE}", self.line, strides=(4,))


#: Integers of two recordings that are compared at once, as so many 64-bit words.
AT_ONCE = 16
#: Keeps the last so many of them.
_LAST = np.array([[0] * (AT_ONCE - k) + [0xFFFFFFFF] * k for k in range(AT_ONCE + 1)], np.uint32).view(np.uint64)


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits of rows of AT_ONCE / 2 words."""
    n = np.bitwise_count(x).view(np.uint64).ravel()
    n = (n & np.uint64(0x00FF00FF00FF00FF)) + ((n >> np.uint64(8)) & np.uint64(0x00FF00FF00FF00FF))
    return ((n * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


def _errors(one: Side, two: Side, x: np.ndarray, y: np.ndarray, overlap: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs have at most so many differing bits in the overlapping integers that begin at x and at y, and how many they have.

    A pair is left as soon as it has more.  No overlap is under AT_ONCE.
    """
    first, second = one.windows(), two.windows()
    words = lambda w, at: w[at].view(np.uint64).reshape(-1, AT_ONCE // 2)
    kept, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    some = max(1, COMPARED // AT_ONCE)
    for begin in range(0, len(x), some):
        left = np.arange(begin, min(begin + some, len(x)))
        errors, done = np.zeros(len(left), np.int64), 0
        while len(left):
            rest = overlap[left] - done
            # the last integers are compared by a window that ends with them
            last = rest <= AT_ONCE
            at = np.where(last, overlap[left] - AT_ONCE, done)
            z = words(first, x[left] + at) ^ words(second, y[left] + at)
            ending = np.flatnonzero(last)
            z[ending] &= _LAST[rest[ending]]
            errors += _bits(z)
            near = errors <= most[left]
            ended = near & last
            kept.append(left[ended])
            counts.append(errors[ended])
            on = near & ~last
            left, errors, done = left[on], errors[on], done + AT_ONCE
    return np.concatenate(kept), np.concatenate(counts)


def side_links(one: Side, two: Side | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Links between two sides, or, without a second one, within one, in parts: which recording of the one and of the other, offset of the larger node, votes, errors, overlap."""
    if two is None:
        two, low = one, one.rank + 1
        n = one.starts[one.which + 1] - low
    else:
        at = np.searchsorted(two.key, one.key)
        hit = np.zeros(len(at), bool)
        inside = at < len(two.key)
        hit[inside] = two.key[at[inside]] == one.key[inside]
        at = np.where(hit, at, 0)
        low = two.starts[at]
        n = np.where(hit, two.starts[np.minimum(at + 1, len(two.starts) - 1)] - low, 0)
        low, n = low[one.which], n[one.which]
    shared = np.flatnonzero(n)
    if not len(shared):
        return
    low, n, rec = low[shared], n[shared], one.rec[shared].astype(np.int64)
    # a pair, its offset and whether the key counts as two in one number, which sorts fast
    half = int(two.size.max())
    span = (int(one.size.max()) + half).bit_length()
    wide = len(two.node).bit_length()
    mine = (rec << (wide + span + 1)) + ((one.place[shared].astype(np.int64) + half) << 1) + (one.votes[shared] - 1)
    other = (two.rec_by_key.astype(np.int64) << (span + 1)) - (two.place_by_key.astype(np.int64) << 1)
    last = np.flatnonzero(np.concatenate((rec[1:] != rec[:-1], [True])))  # of each recording's keys
    upto = np.cumsum(n)[last]
    near, least, at, done = 1 << 32, (1 << wide) - 1, 0, 0
    while at < len(last):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        rows = slice(done, int(last[to - 1]) + 1)
        at, done, m = to, rows.stop, n[rows]
        j = np.repeat(low[rows] - (np.cumsum(m) - m), m)
        j += np.arange(len(j))
        x = other[j]
        x += np.repeat(mine[rows], m)
        x.sort()
        twice, x = x & 1, x >> 1
        heads = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        total = np.diff(np.append(heads, len(x))) + np.add.reduceat(twice, heads)
        x = x[heads]
        pair, shift = x >> span, (x & ((1 << span) - 1)) - half
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        peak, several = starts.copy(), np.diff(np.append(starts, len(x)))
        many = np.flatnonzero(several > 1)
        if len(many):
            m = several[many]
            begin = np.cumsum(m) - m
            of = np.repeat(starts[many] - begin, m) + np.arange(m.sum())
            later = np.where(one.node[pair[of] >> wide] > two.node[pair[of] & least], shift[of] > 0, shift[of] < 0)
            # most votes, then the least distance, then the later offset
            order = (total[of] << 34) | ((near - np.abs(shift[of])) << 1) | later
            peak[many] = of[order == np.repeat(np.maximum.reduceat(order, begin), m)]
        pair, shift, votes = pair[starts], shift[peak], total[peak]
        a, b, x, y = pair >> wide, pair & least, np.maximum(0, shift), np.maximum(0, -shift)
        overlap = np.minimum(one.size[a] - x, two.size[b] - y)
        tried = np.flatnonzero((overlap >= OVERLAP) & ((votes >= VOTES) | (overlap < FEW)))
        a, b, overlap = a[tried], b[tried], overlap[tried]
        found, errors = _errors(one, two, one.base[a] + x[tried], two.base[b] + y[tried], overlap, np.floor(ERRORS * 32 * overlap).astype(np.int64))
        if len(found):
            a, b, shift = a[found], b[found], shift[tried[found]]
            yield a, b, np.where(one.node[a] > two.node[b], shift, -shift), votes[tried[found]], errors, overlap[found]


def block_links(node: np.ndarray, side: np.ndarray, fps: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Links between two sides, or, if there is one, within it, in parts: places of the larger and the smaller node, offset, votes, errors, overlap."""
    places = [np.flatnonzero(side == k) for k in (0, 1)]
    sides = [Side(node[p], [fps[k] for k in p]) for p in places if len(p)]
    for a, b, *facts in side_links(*sides):
        a, b = places[0][a], places[len(sides) - 1][b]
        yield np.where(node[a] > node[b], a, b), np.where(node[a] > node[b], b, a), *facts


LINKS = "node long, links long, root long, ref long, offset int, votes long, errors long, overlap int"


def _summed(node: np.ndarray, links: Iterator[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
    """Of links between places of nodes: for each node with a link, as LINKS."""
    from quarryloom.llm.simhash import forest

    # only nodes with links are held, in order, so that the smallest place of a component is its smallest node
    known, count, root, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.full((5, 0), -1, np.int64)
    for a, b, *facts in links:
        a, b = node[a], node[b]
        a, b = np.maximum(a, b), np.minimum(a, b)
        held = np.unique(np.concatenate((known, a, b)))
        moved, a, b = np.searchsorted(held, known), np.searchsorted(held, a), np.searchsorted(held, b)
        label, n, top = np.arange(len(held)), np.zeros(len(held), np.int64), np.full((5, len(held)), -1, np.int64)
        n[moved], label[moved], top[:, moved] = count, moved[root], best
        top[0, moved] = np.where(best[0] >= 0, moved[best[0]] if len(moved) else best[0], -1)
        n += np.bincount(a, minlength=len(held)) + np.bincount(b, minlength=len(held))
        label = forest(len(held), np.concatenate((a, np.arange(len(held)))), np.concatenate((b, label)))
        has = np.flatnonzero(top[0] >= 0)
        of, found = np.concatenate((a, has)), np.concatenate((np.stack((b, *facts)), top[:, has]), 1)
        by = np.lexsort((found[0], -found[3], found[2], of))  # a reference, offset, votes, errors, overlap
        last = by[np.flatnonzero(np.concatenate((of[by][1:] != of[by][:-1], [True])))]
        top[:, of[last]] = found[:, last]
        known, count, root, best = held, n, label, top
    if not len(known):
        return None
    none = best[0] < 0
    columns = [pa.array(known), pa.array(count), pa.array(known[root]), pa.array(known[np.maximum(best[0], 0)], mask=none)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, kind, mask=none) for x, kind in zip(best[1:], kinds, strict=True))], ["node", "links", "root", "ref", "offset", "votes", "errors", "overlap"])


def _blocks(where: str, cell: int, most: int, skip: int = 0) -> Iterator[Side]:
    """The distinct fingerprints of a cell by blocks of about `most` bytes, always the same ones, from the given one on."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(where)
    paths = sorted(i.path for i in store.get_file_info(fs.FileSelector(f"{base}/cell={cell}", allow_not_found=True)) if i.path.endswith(".parquet"))
    seen, held, size, nth = np.zeros(0, np.int64), {}, 0, 0
    for path in paths:
        with store.open_input_file(path) as source:
            for batch in pq.ParquetFile(source, buffer_size=1 << 20).iter_batches(256, columns=["node", "fp"]):
                nodes = batch.column(0).to_numpy()
                ended: set[int] = set()  # nodes of blocks that end in this batch
                fresh = np.flatnonzero(seen[np.minimum(np.searchsorted(seen, nodes), len(seen) - 1)] != nodes) if len(seen) else np.arange(len(nodes))
                for node, fp in zip(nodes[fresh].tolist(), batch.column(1).take(pa.array(fresh)).to_pylist(), strict=True):
                    if not fp or node in held or node in ended:
                        continue
                    if held and size + len(fp) + APIECE > most:
                        if nth >= skip:
                            yield Side(np.array(list(held), np.int64), list(held.values()))
                        ended.update(held)
                        seen, held, size, nth = np.union1d(seen, np.array(list(held), np.int64)), {}, 0, nth + 1
                    held[node] = fp
                    size += len(fp) + APIECE
    if held and nth >= skip:
        yield Side(np.array(list(held), np.int64), list(held.values()))


def _pairs_of_cells(where: str, tasks: list[tuple[int, int]], most: int) -> Callable:
    """A block of the one cell and one of the other are held at a time."""

    def sides(i: int, j: int) -> Iterator[tuple[Side, Side | None]]:
        for nth, one in enumerate(_blocks(where, i, most)):
            if i == j:
                yield one, None
            for two in _blocks(where, j, most, nth + 1 if i == j else 0):
                yield one, two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for one, two in sides(*tasks[task]):
                    both = (one,) if two is None else (one, two)
                    ahead = 0 if two is None else len(one.node)
                    made = _summed(np.concatenate([s.node for s in both]), ((a, b + ahead, *facts) for a, b, *facts in side_links(*both)))
                    if made is not None:
                        yield made

    return run


def aligned(spark: SparkSession, where: str, cells: int, *, block: int = CELL) -> DataFrame:
    """where: files of node and fp by cell.  For each pair of blocks and each node with a link there: links (how many), root (of a forest of the blocks' links), and as LINKS the best link with a smaller node."""
    tasks = [(i, j) for i in range(cells) for j in range(i, cells)]
    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(_pairs_of_cells(where, tasks, block), LINKS)


def align(prints: DataFrame, *, block: int = CELL) -> DataFrame:
    """prints: a, b, fp, mark.  Columns: a, b, n_items, fp_sha256, class_a, class_b, links (how many other fingerprints it aligns with), and of those with a smaller hash the best one: ref_a, ref_b, offset, votes, errors, overlap."""
    from quarryloom.llm.simhash import components

    spark = prints.sparkSession
    where = fresh_dir(spark, "chroma")
    # so many that their pairs keep all cores busy; a cell may be of any size
    cells = max(CELLS, math.isqrt(8 * spark.sparkContext.defaultParallelism))
    alone = F.xxhash64("a", "b", F.lit(0))  # nothing is known of what has no samples
    named = prints.withColumn("node", F.when(F.octet_length("fp") > 0, F.xxhash64("fp")).when(F.col("mark").isNotNull(), F.xxhash64("mark")).otherwise(alone)).drop("mark")
    celled = named.withColumn("cell", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(cells)).cast("int"))
    celled.write.partitionBy("cell").parquet(where)
    stored = spark.read.schema(celled.schema).parquet(where)
    # fingerprints are moved by nothing that follows
    rows = stored.select("a", "b", "node", (F.octet_length("fp") / 4).cast("long").alias("n_items"), F.sha2("fp", 256).alias("fp_sha256"))
    nodes = stored.groupBy("node").agg(F.min(F.struct("a", "b")).alias("least"), F.count(F.lit(1)).alias("n"))
    links = filed(aligned(spark, where, cells, block=block))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = F.max_by(F.when(F.col("ref").isNotNull(), F.struct("ref", "offset", "votes", "errors", "overlap")), F.when(F.col("ref").isNotNull(), F.struct(F.col("votes"), -F.col("errors"), F.col("ref"))))
    best = cut(links.groupBy("node").agg(facts.alias("l"), F.sum("links").alias("links")))
    small = nodes.select("node", "least", "n")
    rooted = small.join(roots, "node", "left").select("node", "least", "n", F.coalesce("root", "node").alias("root"))
    classes = join_hot(rooted, rooted.groupBy("root").agg(F.min("least").alias("class"), F.count(F.lit(1)).alias("m")), "root", "m").select("node", "class", "n")
    # references are named before the outer join, so that recordings without one do not meet under a null key
    named = best.where("l is not null").join(small.select(F.col("node").alias("m"), F.col("least").alias("ref_row")), F.col("l.ref") == F.col("m")).select("node", "l", "ref_row")
    known = cut(classes.join(named, "node", "left").join(best.select("node", "links"), "node", "left"))
    return join_hot(rows, known, "node", "n").select(
        "a", "b", "n_items", "fp_sha256", F.col("class.a").alias("class_a"), F.col("class.b").alias("class_b"), F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.col("ref_row.a").alias("ref_a"), F.col("ref_row.b").alias("ref_b"), F.col("l.offset").alias("offset"), F.col("l.votes").alias("votes"), F.col("l.errors").alias("errors"), F.col("l.overlap").alias("overlap"),
    )


def op8_chroma(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a melody: its fingerprint, its class and the recording it is aligned with."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    found = align(fingerprint(turns, first_id="conv_id", second_id="turn", media_column="text", load=melody))
    return found.withColumnsRenamed({"a": "conv_id", "b": "turn", "class_a": "class_conv_id", "class_b": "class_turn", "ref_a": "ref_conv_id", "ref_b": "ref_turn"})
