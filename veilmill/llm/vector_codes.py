"""Vector code compression by delta-maintained Lloyd rounds.

Vectors lie in blocks, in a table bucketed by block. Each round's assignments are a table with the same buckets, so a round
meets its vectors and their previous assignments bucket by bucket: no vector is shuffled after the first layout. Running sums
and counts of each codebook entry are kept as whole numbers; a round shuffles only what the parts whose assignment changed
add to them and take from them, summed up in each task first, and at most 256 entries a part position reach the driver.

Whole numbers are exact at any size: what doubles can't hold is worked out in Python's whole numbers, and sums move in limbs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import bucketed, written

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024
#: Vectors of a block, and rows that a bucket of the layout is meant for.
BLOCK, BUCKET = 1_024, 8_192
#: Bits of a limb; sums of 2**22 tasks' limbs fit a long.
LIMB = 40
LONG = 2**63
ROUND = "block bigint, codes binary, part int, entry int, limb int, n bigint, sums array<bigint>"


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label of the rows whose vector is not null and holds finite components only."""
    fine = "embedding is not null and forall(embedding, c -> c is not null and not isnan(c) and abs(cast(c as double)) < double('infinity'))"
    return vectors.select("vec_id", "embedding", "label").where(fine)


def _bounds(width: int) -> list[int]:
    return [i * width // PARTS for i in range(PARTS + 1)]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(FACTOR * x): doubles where all sums of squares below are exact in them, else Python's whole numbers."""
    x = x.astype(np.float64)
    most = np.abs(x).max(initial=0.0)
    if most < 2**53 / FACTOR:
        y = np.floor(x * FACTOR)
        return y if 8 * x.shape[-1] * (most * FACTOR + 1) ** 2 < 2**53 else _objects(y.astype(np.int64))
    return _objects([[math.floor(c * FACTOR) if abs(c) < 2**40 else int(c) * FACTOR for c in row] for row in x.tolist()], x.shape)


def _objects(rows, shape: tuple | None = None) -> np.ndarray:
    rows = rows.tolist() if isinstance(rows, np.ndarray) else rows
    out = np.empty(shape or (len(rows), len(rows[0]) if rows else 0), object)
    for i, row in enumerate(rows):
        out[i, :] = row
    return out


def _as_whole(entries: list[list[int]], width: int) -> np.ndarray:
    """Codebook entries for distances: doubles if small enough, else Python's whole numbers."""
    most = max((abs(c) for e in entries for c in e), default=0)
    if 8 * width * (most + 1) ** 2 < 2**53:
        return np.array(entries, np.float64).reshape(len(entries), width)
    return _objects(entries, (len(entries), width))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest entry (the lower one of several) and its squared distance, exact."""
    if x.dtype == object or entries.dtype == object:
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        for i, row in enumerate(x.tolist()):
            all_of = [sum((int(a) - int(b)) ** 2 for a, b in zip(row, e, strict=True)) for e in entries.tolist()]
            code[i] = min(range(len(all_of)), key=all_of.__getitem__)
            error[i] = all_of[code[i]]
        return code, error
    squares = (entries**2).sum(axis=1)
    apart = squares - 2 * (x @ entries.T)
    code = apart.argmin(axis=1)
    return code, (apart[np.arange(len(x)), code] + (x**2).sum(axis=1)).astype(np.int64)


def _blocks(vectors: DataFrame) -> DataFrame:
    """block, width, vec_ids, labels, x: up to BLOCK vectors of a width each, components as they came, in doubles or floats."""
    ids, label = vectors.schema["vec_id"].dataType, vectors.schema["label"].dataType
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    schema = StructType([StructField("block", LongType()), StructField("width", IntegerType()), StructField("vec_ids", ArrayType(ids)), StructField("labels", ArrayType(label)), StructField("x", BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column("embedding")
            width, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            first = np.cumsum(width) - width
            for w in np.unique(width):
                of_width = np.flatnonzero(width == w)
                for at in range(0, len(of_width), BLOCK):
                    some = of_width[at : at + BLOCK]
                    x = flat[first[some][:, None] + np.arange(w)]
                    one = pa.array([0, len(some)], pa.int32())
                    parts = [pa.ListArray.from_arrays(one, batch.column(c).take(pa.array(some))) for c in ("vec_id", "label")]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([w], pa.int32()), *parts, pa.array([x.tobytes()], pa.binary())], ["block", "width", "vec_ids", "labels", "x"])
                    number += 1

    return vectors.mapInArrow(task, schema)


def _vectors(binary: bytes, width: int, single: bool) -> np.ndarray:
    return whole(np.frombuffer(binary, np.float32 if single else np.float64).reshape(-1, width))


def _limbs(v: int) -> list[int]:
    out = []
    while not -(2**LIMB) <= v < 2**LIMB:
        out.append(v & (2**LIMB - 1))
        v >>= LIMB
    return [*out, v]


def _round(width: int, single: bool, codebooks: list[list[list[int]]]):
    """Assigns blocks; gives their codes, and behind the last block what the changed parts add to each entry's sums and count."""
    bounds = _bounds(width)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_as_whole(c, bounds[p + 1] - bounds[p]) for p, c in enumerate(codebooks)]
        n = np.zeros((PARTS, ENTRIES), np.int64)
        sums = [np.zeros((ENTRIES, bounds[p + 1] - bounds[p]), object) for p in range(PARTS)]
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                x = _vectors(row["x"], width, single) if width else np.zeros((len(row["x"]), 0))
                old = np.frombuffer(row["codes"], np.uint8).reshape(PARTS, -1) if row.get("codes") is not None else None
                new = np.zeros((PARTS, len(x)), np.uint8)
                for p in range(PARTS):
                    part = x[:, bounds[p] : bounds[p + 1]]
                    new[p] = nearest(part, entries[p])[0]
                    at = np.flatnonzero(new[p] != old[p]) if old is not None else np.arange(len(x))
                    for codes, sign in ((new[p], 1), *([(old[p], -1)] if old is not None else [])):
                        n[p] += sign * np.bincount(codes[at], minlength=ENTRIES)
                        for j in range(part.shape[1]):
                            if part.dtype == object:
                                for c, v in zip(codes[at].tolist(), part[at, j].tolist(), strict=True):
                                    sums[p][c, j] += sign * v
                            else:
                                sums[p][:, j] += sign * np.bincount(codes[at], part[at, j], ENTRIES).astype(np.int64)
                last = row["block"]
                yield pa.RecordBatch.from_pylist([{"block": last, "codes": new.tobytes()}], _ARROW)
        rows = []
        for p in range(PARTS):
            for e in np.flatnonzero((n[p] != 0) | (sums[p] != 0).any(axis=1)).tolist():
                limbs = [_limbs(int(v)) for v in sums[p][e]]
                for k in range(max((len(x) for x in limbs), default=1)):
                    rows.append({"block": last, "part": p, "entry": e, "limb": k, "n": int(n[p, e]) if not k else 0, "sums": [x[k] if k < len(x) else 0 for x in limbs]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return task


_ARROW = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _contributions(round_rows: DataFrame, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By part and entry: what is added to its count and sums. At most PARTS * ENTRIES keys, of one limb each unless numbers are huge."""
    most = max(b - a for a, b in zip(_bounds(width), _bounds(width)[1:], strict=False))
    each = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(most)]
    found = round_rows.where("part is not null").groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *each).collect()
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in found:
        n, sums = out.get((r["part"], r["entry"]), (0, [0] * most))
        out[r["part"], r["entry"]] = n + r["n"], [s + ((r[f"s{j}"] or 0) << LIMB * r["limb"]) for j, s in enumerate(sums)]
    return out


def train(vectors: DataFrame) -> tuple[DataFrame, int, list[list[list[int]]]]:
    """The blocks, the width that codebooks are for, and the codebooks (by part, entry, position) after ROUNDS rounds.

    The width is the one of most rows, the larger of several such.
    """
    kept = _usable(vectors)
    single = kept.schema["embedding"].dataType.elementType.simpleString() == "float"
    buckets = max(8, min(8_192, vectors.count() // BUCKET))
    blocks = bucketed(_blocks(kept).repartition(buckets, "block"), "vector-blocks", buckets, "block")
    common = blocks.groupBy("width").agg(F.sum(F.size("vec_ids")).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return blocks, 0, []
    width = common["width"]
    bounds = _bounds(width)
    start = kept.where(F.size("embedding") == width).orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(ENTRIES).collect()
    first = whole(np.array([r["embedding"] for r in start], np.float64).reshape(len(start), width)).tolist()
    books = [[[int(c) for c in row[a:b]] for row in first] for a, b in zip(bounds, bounds[1:], strict=False)]
    counts = {(p, e): (0, [0] * (bounds[p + 1] - bounds[p])) for p in range(PARTS) for e in range(len(start))}
    meant = blocks.where(F.col("width") == width).select("block", "x") if width else blocks.where("width = 0").select("block", F.expr("cast(repeat(' ', size(vec_ids)) as binary)").alias("x"))
    before = None
    for _ in range(ROUNDS):
        seen = meant if before is None else meant.join(before.where("codes is not null").select("block", "codes"), "block")
        before = bucketed(seen.mapInArrow(_round(width, single, books), ROUND), "vector-codes", buckets, "block")
        for (p, e), (n, sums) in _contributions(before, width).items():
            old_n, old = counts[p, e]
            counts[p, e] = old_n + n, [a + b for a, b in zip(old, sums, strict=False)]
        books = [[[s // counts[p, e][0] for s in counts[p, e][1]] if counts[p, e][0] else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]
    return blocks, width, books


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all entries' components, by part, entry, position."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def decode(coded: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """coded with vector array<double>: the entries that its code names, back in the scale of the embeddings; null without code."""
    parts = [f"cast(element_at(from_json('{[[c / FACTOR for c in e] for e in book]}', 'array<array<double>>'), 1 + cast(conv(substr(code, {2 * p + 1}, 2), 16, 10) as int)) as array<double>)" for p, book in enumerate(books)]
    return coded.withColumn("vector", F.when(F.col("code").isNotNull(), F.expr(f"concat({', '.join(parts)})")))


def assigned(blocks: DataFrame, width: int, books: list[list[list[int]]], single: bool) -> DataFrame:
    """vec_id, label, code, error of every vector in blocks; code and error are null for other widths."""
    bounds = _bounds(width)
    ids, label = blocks.schema["vec_ids"].dataType.elementType, blocks.schema["labels"].dataType.elementType
    schema = StructType([StructField("vec_id", ids), StructField("label", label), StructField("code", _string()), StructField("error", LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_as_whole(c, bounds[p + 1] - bounds[p]) for p, c in enumerate(books)]
        for batch in batches:
            for i, (w, binary) in enumerate(zip(batch.column("width").to_pylist(), batch.column("x").to_pylist(), strict=True)):
                who, labels = batch.column("vec_ids")[i].values, batch.column("labels")[i].values
                code, error = [None] * len(who), [None] * len(who)
                if w == width:
                    x = _vectors(binary, width, single) if width else np.zeros((len(who), 0))
                    found = [nearest(x[:, a:b], e) for a, b, e in zip(bounds, bounds[1:], entries, strict=False)]
                    code = ["%02x%02x%02x%02x" % c for c in zip(*(f[0].tolist() for f in found), strict=True)]
                    error = [min(sum(e), LONG - 1) for e in zip(*(f[1].tolist() for f in found), strict=True)]
                yield pa.RecordBatch.from_arrays([who, labels, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.select("width", "vec_ids", "labels", "x").mapInArrow(task, schema)


def _string():
    from pyspark.sql.types import StringType

    return StringType()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label of every usable vector.

    vectors: vec_id, embedding, label; other columns are left out. Rows without a vector, or with null or non-finite
    components, are dropped. Codebooks are for the width of most rows; other widths have no code and no error. Parts of a width that
    4 does not divide differ in length by one. Null and repeated vec_ids are rows like others: the first entries go by vec_id, nulls last,
    then by vector. Fewer than 256 rows give as many entries. Errors beyond a long, single or summed, show as the largest one. An empty
    table gives none.
    """
    blocks, width, books = train(vectors)
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    rows = written(assigned(blocks, width, books, single), "vector-errors")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG - 1).cast("decimal(38,0)")).cast("bigint")
    sums = rows.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of_label")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")
