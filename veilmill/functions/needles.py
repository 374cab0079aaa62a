"""Counting many strings in many texts in one pass: windows of texts meet a bit map of what is asked for, in numpy.

A window of q code points stands under a 64-bit key, the same for strings that are asked for and for texts. Strings of up to GRAM code points
are counted by their keys. Longer ones are looked for by their windows of GRAM code points, whose texts are told.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of the longest windows, and those of texts that are read at once.
GRAM, BLOCK = 16, 1 << 16
#: Bits of a map for each key, and of the largest map, as a power of two: 4 MB.
SPARSE, MOST = 16, 25
#: Counts that a task holds before it passes them on.
HELD = 1 << 20

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (splitmix64)."""
    x = x.astype(_U) + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A factor for each place of a window, and a number for each size.
_FACTORS = _mixed(np.arange(1, GRAM + 1)) | _U(1)
_SIZES = _mixed(np.arange(1000, 1001 + GRAM))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def _keys(points: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(q, keys of the windows of q code points at all places) for sizes, ascending."""
    mixed, n = _mixed(points), len(points)
    total = np.zeros(n, dtype=_U)
    for q in range(1, min(max(sizes, default=0), n) + 1):
        total = total[: n - q + 1] + mixed[q - 1 :] * _FACTORS[q - 1]
        if q in sizes:
            yield q, total + _SIZES[q]


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, needle to _id, size, anchor, key: the key of a needle, or those of all its windows, anchors, if it is longer than GRAM."""
    for batch in batches:
        for number, needle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            points = _points(needle)
            q = min(len(points), GRAM)
            keys = np.unique(next(_keys(points, [q]))[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, dtype=np.int64)), pa.array(np.full(len(keys), q, dtype=np.int32)), pa.array(np.full(len(keys), len(points) > GRAM)), pa.array(keys.view(np.int64))], ["_id", "size", "anchor", "key"])


def bit_map(keys: DataFrame) -> np.ndarray | None:
    """The keys (key) as 64-bit words of a map that grows with their number up to 2**MOST bits; None for no keys. Keys that share a bit with one are met later."""
    n = keys.count()
    if not n:
        return None
    bits = min(MOST, max(16, (n * SPARSE - 1).bit_length()))
    place = F.expr(f"shiftrightunsigned(key, {64 - bits})")
    words = keys.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63L as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=_U)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy().view(_U)
    return out


def _in_map(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys >> _U(64 - (len(words).bit_length() + 5))
    return (words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) != 0


class _Counts:
    """Numbers by key, put together as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            keys = np.sort(keys)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.parts.append((keys[first], np.diff(np.append(first, len(keys)))))
            self.size += len(first)

    def put_together(self) -> None:
        keys, numbers = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.argsort(keys)
        keys, numbers = keys[order], numbers[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        self.parts = [(keys[first], np.add.reduceat(numbers, first))]
        self.size = len(first)

    def full(self) -> bool:
        """Whether HELD / 2 distinct keys are held, looked at each time when HELD parts of counts are."""
        if self.size >= HELD:
            self.put_together()
        return self.size >= HELD // 2 and len(self.parts) == 1

    def taken(self) -> pa.RecordBatch:
        self.put_together()
        (keys, numbers), self.parts, self.size = self.parts[0], [], 0
        return _batch(keys, None, numbers)


def _batch(keys: np.ndarray, rows: np.ndarray | None, numbers: np.ndarray) -> pa.RecordBatch:
    where = pa.nulls(len(keys), pa.int64()) if rows is None else pa.array(rows.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), where, pa.array(numbers.astype(np.int64))], ["key", "_row", "n"])


def counter(sizes: list[int], exact: np.ndarray | None, anchors: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """body, _row to key, _row, n: how often windows of the sizes that the map exact has stand in the bodies, without overlaps, _row null; and, with n 1,
    which bodies have a window of GRAM code points that the map anchors has. Sums are partial, and a body may tell an anchor again.

    Bodies are put together to BLOCK code points; longer ones are read in pieces. Windows that overlap one of the same key are counted from
    the left, one by one, over the ends of pieces too.
    """
    wanted = sorted({*sizes, *([GRAM] if anchors is not None else [])})

    def apart(keys: np.ndarray, hit: np.ndarray, q: int, at: int | None, limit: int, ends: dict[int, int]) -> np.ndarray:
        """The keys at the places hit, without those that overlap an earlier one of their own; at is where a piece of a text starts."""
        if q == 1:
            return keys[hit]
        near = np.zeros(len(keys), dtype=bool)
        for d in range(1, min(q, len(keys))):
            same = keys[d:] == keys[:-d]
            if same.any():
                near[:-d] |= same
                near[d:] |= same
        if at is not None:
            near[: q - 1] = True
            near[max(0, limit - q + 1) :] = True
        close = near[hit]
        slow, kept = hit[close], []
        for place, key in zip(((at or 0) + slow).tolist(), keys[slow].tolist(), strict=True):
            if ends.get(key, -1) <= place:
                ends[key] = place + q
                kept.append(key)
        return np.concatenate((keys[hit[~close]], np.array(kept, dtype=_U)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()

        def read(text: str, lengths: list[int], rows: list[int], at: int | None, ends: dict[int, int]) -> Iterator[pa.RecordBatch]:
            points = _points(text)
            limit = len(points) if at is None else min(BLOCK, len(points))
            close = np.cumsum(lengths)
            left = np.repeat(close, lengths) - np.arange(len(points))
            for q, keys in _keys(points, wanted):
                inside = left[: len(keys)] >= q
                inside[limit:] = False
                if q in sizes:
                    counts.add(apart(keys, np.flatnonzero(inside & _in_map(exact, keys)), q, at, limit, ends))
                if q == GRAM and anchors is not None:
                    hit = np.flatnonzero(inside & _in_map(anchors, keys))
                    if len(hit):
                        pairs = np.unique(np.stack((np.searchsorted(close, hit, side="right").astype(_U), keys[hit])), axis=1)
                        yield _batch(np.ascontiguousarray(pairs[1]), np.array(rows, dtype=np.int64)[pairs[0].astype(np.int64)], np.ones(pairs.shape[1]))
            if counts.full():
                yield counts.taken()

        texts: list[str] = []
        rows: list[int] = []
        held = 0
        for batch in batches:
            for body, row in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                body = body.as_py()
                if not body:
                    continue
                if len(body) > BLOCK:
                    ends: dict[int, int] = {}
                    for at in range(0, len(body), BLOCK):
                        piece = body[at : at + BLOCK + GRAM - 1]
                        yield from read(piece, [len(piece)], [row], at, ends)
                    continue
                texts.append(body)
                rows.append(row)
                held += len(body)
                if held >= BLOCK:
                    yield from read("".join(texts), [len(t) for t in texts], rows, None, {})
                    texts, rows, held = [], [], 0
        if texts:
            yield from read("".join(texts), [len(t) for t in texts], rows, None, {})
        if counts.size:
            yield counts.taken()

    return run
