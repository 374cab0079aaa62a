"""Suffix dedup: removes bytes that a 100-byte string covers which also starts earlier in the corpus.

No suffix is sorted here. Places are sampled by content, as in string synchronising sets: wherever two equal strings of 100
bytes stand, their first sampled place is at the same distance from their starts, so repeats are found among the places that
share a sampled tuple, by comparing hashes of 100-byte strings. See the README for why.

1. Sampled: in each window of 100 bytes, the leftmost least hash among its 36-byte tuples. About one place in thirty is.
   The tuple is the place's name.
2. Blocks: starts with the same sampled place are neighbours, and form a block; what these strings span, from
   the block's first start to 100 bytes after its last, names the block.
   Names that occur once are dropped; equal blocks after the first are repeats as a whole.
3. The starts of each name's distinct blocks are grouped by the hash of the 100 bytes from there on: all but the first of equal
   ones are repeats.

Names and prefixes are compared as 64-bit hashes. A name with very many different blocks, such as one in a line
of boilerplate, is not gathered in one task: the starts of its blocks are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .shingles import A, B, C, S32, mix, slices

LENGTH, TUPLE = 100, 36
#: Blocks of a name from which its starts are dealt out one by one; fewer are judged together, in about 1 KB of memory each.
HOT_BLOCKS = 65_536
PLACE_BITS = np.uint64(28)


def _light(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> S32)) * B


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of TUPLE (32 + 4) and of LENGTH (64 + 32 + 4) bytes, by their starts."""
    h, size, by_size = mix(data.astype(np.uint64) * A + C), 1, {}
    while size < 64:
        h = _light(h[:-size] * A + h[size:]) if len(h) > size else h[:0]
        size *= 2
        by_size[size] = h
    n, m = max(0, len(data) - TUPLE + 1), max(0, len(data) - LENGTH + 1)
    tuples = mix(by_size[32][:n] * C + by_size[4][32 : 32 + n])
    strings = mix(_light(by_size[64][:m] * C + by_size[32][64 : 64 + m]) * C + by_size[4][96 : 96 + m])
    return tuples, strings


def first_samples(tuples: np.ndarray, starts: int) -> np.ndarray:
    """For each start, the place of the leftmost least tuple in the string of LENGTH bytes there."""
    # Texts that the place's bits don't hold get more of them.
    low = np.uint64((1 << max(int(PLACE_BITS), len(tuples).bit_length())) - 1)
    least = (tuples & ~low) | np.arange(len(tuples), dtype=np.uint64)
    size, width = 1, LENGTH - TUPLE + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    return (least[:starts] & low).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc, part, text: name, block, doc, part, lo, hi of each block, lo and hi its first and last start."""
    for batch in batches:
        for part, data, offsets in slices(batch):
            sizes = np.diff(offsets)
            if not (sizes >= LENGTH).any():
                continue
            tuples, strings = window_hashes(data)
            owner = np.repeat(np.arange(len(sizes)), sizes)[: len(strings)]
            starts = np.flatnonzero(np.arange(len(strings)) + LENGTH <= offsets[1:][owner])
            at, owner = first_samples(tuples, len(strings))[starts], owner[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(new)
            lo, hi, own = starts[heads], starts[np.append(heads[1:], len(starts)) - 1], owner[heads]
            block = mix(mix(strings[lo] * A + strings[hi]) * C + (hi - lo).astype(np.uint64))
            take = pa.array(own)
            base = offsets[:-1][own]
            yield pa.record_batch(
                [pa.array(tuples[at[heads]].view(np.int64)), pa.array(block.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))],
                names=["name", "block", "doc", "part", "lo", "hi"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, part, text compressed before it is shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            packed = [press.compress(t.encode()) for t in some.column(2).to_pylist()]
            yield pa.record_batch([some.column(0), some.column(1), pa.array(packed, pa.binary())], names=["doc", "part", "packed"])


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc, part, packed, checks: the bytes that each block to be looked into spans."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            names, hot, docs, parts, los, spans = [], [], [], [], [], []
            for r in batch.slice(at, 64).to_pylist():
                text = _unpack(r["packed"])
                for c in r["checks"]:
                    names.append(c["name"])
                    hot.append(c["hot"])
                    docs.append(r["doc"])
                    parts.append(r["part"])
                    los.append(c["lo"])
                    spans.append(text[c["lo"] : c["hi"] + LENGTH])
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(hot, pa.bool_()), pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), pa.array(los, pa.int32()), pa.array(spans, pa.binary())], names=["name", "hot", "doc", "part", "lo", "span"])


def _starts(names: np.ndarray, docs: np.ndarray, parts: np.ndarray, los: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, ...]:
    """name, prefix hash, doc, part, start of each start of the blocks."""
    sizes = np.array([len(s) for s in spans], np.int64)
    _, strings = window_hashes(np.frombuffer(b"".join(spans), np.uint8))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return names[owner], strings[first[owner] + inside], docs[owner], parts[owner], (los[owner] + inside).astype(np.int32)


def repeats_of(names: np.ndarray, prefixes: np.ndarray, docs: np.ndarray, parts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which starts are not the first of their 100-byte prefix: sorted, those equal to the neighbour before, unless at the place of the first."""
    order = np.lexsort((starts, parts, docs, prefixes, names))
    n, p, d, q, s = names[order], prefixes[order], docs[order], parts[order], starts[order]
    new = np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (p[1:] != p[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, int)
    out = (d != d[first]) | (q != q[first]) | (s != s[first])
    flags = np.empty(len(order), bool)
    flags[order] = out
    return flags


def _runs(docs: np.ndarray, parts: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Starts as runs [lo, hi] of neighbours."""
    order = np.lexsort((starts, parts, docs))
    d, p, s = docs[order], parts[order], starts[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (s[1:] > s[:-1] + 1)
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(s)) - 1 if len(s) else heads
    return pa.record_batch([pa.array(d[heads]), pa.array(p[heads]), pa.array(s[heads]), pa.array(s[ends])], names=["doc", "part", "lo", "hi"])


def _merged(batches: Iterator[pa.RecordBatch], bytes_at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """From name, doc, part, lo, span sorted by name: the runs of repeats. Holds whole names of about bytes_at_once together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def judged(table: pa.Table) -> pa.RecordBatch:
        column = lambda c: table.column(c).to_numpy()
        rows = _starts(column("name"), column("doc"), column("part"), column("lo"), table.column("span").to_pylist())
        again = repeats_of(*rows)
        return _runs(rows[2][again], rows[3][again], rows[4][again])

    for batch in batches:
        for at in range(0, batch.num_rows, 4_096):
            some = batch.slice(at, 4_096)
            held.append(some)
            size += some.nbytes
            if size >= bytes_at_once:
                table = pa.Table.from_batches(held).combine_chunks()
                names = table.column("name").to_numpy()
                last = int(np.searchsorted(names, names[-1]))
                if last:
                    yield judged(table.slice(0, last))
                held = table.slice(last).to_batches()
                size = sum(b.nbytes for b in held)
    if held:
        yield judged(pa.Table.from_batches(held))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4_096):
            some = batch.slice(at, 4_096)
            column = lambda c: some.column(some.schema.get_field_index(c)).to_numpy()  # noqa: B023, E731
            name, prefix, doc, part, start = _starts(column("name"), column("doc"), column("part"), column("lo"), some.column(some.schema.get_field_index("span")).to_pylist())
            yield pa.record_batch([pa.array(prefix.view(np.int64)), pa.array(doc), pa.array(part), pa.array(start)], names=["prefix", "doc", "part", "start"])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc, part, packed, runs: what each document loses and keeps."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text = _unpack(r["packed"])
            spans: list[list[int]] = []
            for lo, hi in sorted((x["lo"], x["hi"] + LENGTH) for x in r["runs"] or ()):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            at, kept = 0, hashlib.sha256()
            for lo, hi in spans:
                kept.update(text[at:lo])
                at = hi
            kept.update(text[at:])
            out.append({"doc_id": r["doc"], "n_bytes": len(text), "n_removed": sum(b - a for a, b in spans), "n_spans": len(spans), "kept_sha256": kept.hexdigest(), "removed": [{"start": a, "end": b} for a, b in spans]})
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(span))]))


def _identified(docs: DataFrame) -> DataFrame:
    """doc, part, text: part tells different texts of one doc_id apart, and is 0 where there is one."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = rows.select("doc", F.xxhash64("text").alias("hash")).where("doc is not null")
    several = hashed.groupBy("doc").agg(F.min("hash").alias("x"), F.max("hash").alias("y")).where("x < y").select("doc")
    several = written(hashed.join(several, "doc", "left_semi").distinct().withColumn("part", F.row_number().over(Window.partitionBy("doc").orderBy("hash")) - 1), "suffix-parts")
    if not several.count():
        return rows.select("doc", F.lit(0).alias("part"), "text")
    return rows.withColumn("hash", F.xxhash64("text")).join(several, ["doc", "hash"], "left").select("doc", F.coalesce("part", F.lit(0)).alias("part"), "text")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """doc, part, lo, hi: runs of starts of 100-byte strings that start earlier too; of rows doc, part, text."""
    blocks = rows.where("doc is not null").mapInArrow(_blocks, "name bigint, block bigint, doc bigint, part int, lo int, hi int")
    named = Window.partitionBy("name").orderBy("block", "doc", "part", "lo")
    every = Window.partitionBy("name")
    alike = Window.partitionBy("name", "block").orderBy("doc", "part", "lo")
    seen = blocks.withColumn("n", F.count("*").over(every)).where("n > 1")
    seen = seen.withColumn("first", F.first(F.struct("doc", "part", "lo")).over(alike)).withColumn("again", F.struct("doc", "part", "lo") != F.col("first"))
    seen = seen.withColumn("other", F.max("block").over(every) != F.min("block").over(every)).where("again or other")
    seen = written(seen.select("name", "doc", "part", "lo", "hi", "n", "again"), "suffix-blocks")
    checks = seen.where("not again").groupBy("doc", "part").agg(F.collect_list(F.struct("name", "lo", "hi", (F.col("n") > HOT_BLOCKS).alias("hot"))).alias("checks"))
    texts = rows.mapInArrow(_packed, "doc bigint, part int, packed binary")
    cut = texts.join(checks, ["doc", "part"]).select("doc", "part", "packed", "checks").mapInArrow(_cut, "name bigint, hot boolean, doc bigint, part int, lo int, span binary")
    cut = written(cut, "suffix-cut")
    columns = ("name", "doc", "part", "lo", "span")
    local = cut.where("not hot").select(*columns).repartition("name").sortWithinPartitions("name").mapInArrow(_merged, "doc bigint, part int, lo int, hi int")
    dealt = cut.where("hot").select(*columns).mapInArrow(_exploded, "prefix bigint, doc bigint, part int, start int")
    first = dealt.groupBy("prefix").agg(F.min(F.struct("doc", "part", "start")).alias("first"))
    dealt = dealt.join(first, "prefix").where(F.struct("doc", "part", "start") != F.col("first")).select("doc", "part", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return seen.where("again").select("doc", "part", "lo", "hi").unionByName(local).unionByName(dealt)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans, ends exclusive) for each row of docs.

    A null text is an empty one. Rows with a null doc_id lose nothing and take nothing from others. Rows that repeat doc_id and text
    are one document; different texts of one doc_id are documents in the order of a hash of their text.
    Empty docs give an empty result; further columns are ignored.
    """
    rows = _identified(docs.select("doc_id", "text"))
    runs = written(repeated_runs(rows), "suffix-runs").groupBy("doc", "part").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    texts = rows.mapInArrow(_packed, "doc bigint, part int, packed binary")
    out = texts.join(runs, ["doc", "part"], "left").select("doc", "part", "packed", "runs")
    return out.mapInArrow(_summary, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start: int, end: int>>")
