"""Best-fit packing of token sequences, planned over a histogram of lengths.

Best-fit decreasing treats pieces of one length alike, so it is run over counts: for each length, longest first, the bins with
the least room that still hold it are filled, a whole range of like bins in one step. The plan is a list of runs: so many
bins from a first one on each take so many pieces of a length from an offset on. Its size depends on the capacity, not on
the number of pieces, and the result is that of best-fit decreasing over the pieces one by one.

Pieces get their rank within their length from counts by (length, hash), so no task holds all of a frequent length. The
plan's runs are exploded to slots, and pieces take the slot of their (length, rank) by an equi-join.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byteruns import chunks, look_up, runs
from .common import written

CAPACITY, END = 2048, 0
#: Words whose ids a worker remembers, words that are encoded in one string, and slots of a run that one row explodes into.
REMEMBERED, TOGETHER, SLOTS = 500_000, 256, 65_536
PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"

_BYTE = np.arange(256)
_SPACE = np.isin(_BYTE, [9, 10, 11, 12, 13, 32])
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
#: Bytes that begin a letter of two bytes (Latin U+00C0 to U+02BF but for the signs of times and division, Cyrillic U+0400 to U+047F).
_LEAD = (_BYTE >= 0xC3) & (_BYTE <= 0xCA) | (_BYTE == 0xD0) | (_BYTE == 0xD1)
#: 0 unknown, 1 letter, 2 digit, 3 mark, 4 apostrophe
_KIND = np.select([_UPPER | (_BYTE >= 97) & (_BYTE <= 122) | _LEAD, (_BYTE >= 48) & (_BYTE <= 57), _BYTE == 39, (_BYTE >= 33) & (_BYTE <= 126)], [1, 2, 4, 3], 0).astype(np.uint8)


class Words:
    """The ids of words seen, one after another, and the place of each word among them."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]

    def _add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        begin = self.starts[-1][-1]
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.ids.append(ids)
        self.starts.append(begin + ends)

    def learn(self, words: list[str]) -> None:
        """Plain words share a string: a word of letters only is one word of the tokenizer, and ids of ASCII words are told apart by their place."""
        letters = [w for w in words if w.isalpha()]
        for at in range(0, len(letters), TOGETHER):
            some = letters[at : at + TOGETHER]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            of = np.array(found.word_ids, np.int64)
            if len(of) and of[-1] == len(some) - 1:
                self._add(some, np.array(found.ids, np.uint32), np.searchsorted(of, np.arange(1, len(some) + 1)))
        rest = [w for w in words if w.isascii() and w not in self.place]
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            self._add(some, np.array(found.ids, np.uint32), np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), np.cumsum([len(w) + 1 for w in some])))
        for w in words:
            if w not in self.place:
                ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
                self._add([w], ids, np.array([len(ids)]))

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where those of each of words begin and how many there are."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > REMEMBERED:
            self.clear()
            new = words
        self.learn(new)
        self.ids, self.starts = [np.concatenate(self.ids)], [np.concatenate(self.starts)]
        at = np.array([self.place[w] for w in words], np.int64)
        starts = self.starts[0]
        return self.ids[0], starts[at], starts[at + 1] - starts[at]


@functools.cache
def _loaded(model: str) -> tuple[Tokenizer, Words, list[str]]:
    tokenizer = Tokenizer.from_str(model)
    return tokenizer, Words(tokenizer), [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _cuts_words(model: str) -> bool:
    """Whether texts may be encoded word by word: white space and ASCII marks always end a word of this tokenizer.

    Asked of the tokenizer itself: its words of samples must be those of their parts.
    """
    tokenizer, _, _ = _loaded(model)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    samples = (["Ab", " ", "cd"], ["ab", ".", "cd"], ["a", "'s", " ", "b"], ["x", "1", "2", "y", "-", "z"], ["B", "\n", "\t", "C", ",", "d"], ["don", "'t", "."], ["(", "a", ")!"])
    return all(ids("".join(s)) == [i for part in s for i in ids(part)] for s in samples) and ids("ABC") == ids("abc")


def encoded(texts: pa.Array, model: str, by_word: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """row, ids of consecutive rows, how many each has: what the tokenizer gives for each text, without special tokens added.

    by_word: each distinct word of a chunk is encoded once. Words end at ASCII white space, and between letters, digits and
    marks, unless an apostrophe may begin a contraction; ASCII capitals are lowered first, unless a combining character may follow.
    Chunks that hold one of the tokenizer's special tokens are encoded text by text.
    """
    tokenizer, known, special = _loaded(model)
    for first, end, data, offsets in chunks(texts):
        whole = bytes(data)
        if not by_word or any(s.encode() in whole for s in special):
            for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
                one = np.array(tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids, np.uint32)
                yield first + i, one, np.array([len(one)])
            continue
        kind, lead = look_up(data, _KIND).copy(), look_up(data, _LEAD)
        trail = np.flatnonzero(lead) + 1
        kind[trail] = np.where((data[trail - 1] == 0xC3) & ((data[trail] == 0x97) | (data[trail] == 0xB7)), 0, 1)
        before, now = kind[:-1], kind[1:]
        cut = np.zeros(len(data), bool)
        cut[1:] = (now > 0) & ((before == 1) & (now != 1) | (before == 2) | (before == 3) & (now < 3))
        signs = trail[kind[trail] == 0]
        cut[signs - 1] = cut[signs] = False
        lower = look_up(data, _UPPER).copy()
        lower[:-1] &= (data[1:] < 128) | lead[1:]
        words, each = runs(data + 32 * lower.view(np.uint8), offsets, look_up(data, ~_SPACE), cut)
        coded = words.dictionary_encode()
        flat, starts, size = known.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = size[codes]
        ends = np.cumsum(n)
        places = np.repeat(starts[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        sums = np.append(0, ends)[np.append(0, np.cumsum(each))]
        yield first, flat[places], np.diff(sums)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of each row's token ids, with END behind the last.

    docs: doc_id, text (null: empty, so END alone); other columns are left out. tokenizer: its file, read by the driver only. Each
    row is a document of its own, whatever ids repeat or are null. Only documents beyond capacity are cut.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    by_word = _cuts_words(model.value)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, flat, each in encoded(batch.column("text"), model.value, by_word):
                ends = np.cumsum(each + 1)
                stream = np.full(int(ends[-1]), END, "<u4")
                mask = np.ones(len(stream), bool)
                mask[ends - 1] = False
                stream[mask] = flat
                n = -(-(each + 1) // capacity)
                row = np.repeat(np.arange(len(each)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, (each + 1)[row] - start)
                at = (ends - each - 1)[row] + start
                cut = [stream[a : a + m].tobytes() for a, m in zip(at, length, strict=True)]
                columns = [doc_ids.take(pa.array(first + row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.binary())] if ids else columns, [*names, "ids"] if ids else names)

    schema = PIECES.replace("doc_id bigint", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}") + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(task, schema)


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, number of bins, pieces a bin, first bin, offset) of best-fit decreasing over counts by length."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by what is left: ranges (first bin, number of bins)
    bins, out = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def take(first: int, n: int, r: int) -> None:
            """Up to n like bins with room r get pieces of length, as long as any are left."""
            nonlocal left, rank
            per = r // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, full, per, first, capacity - r))
                room[r - per * length].append((first, full))
                left, rank = left - full * per, rank + full * per
            if full < n and left:
                out.append((length, rank, 1, left, first + full, capacity - r))
                room[r - left * length].append((first + full, 1))
                full, left, rank = full + 1, 0, rank + left
            if full < n:
                room[r].append((first + full, n - full))

        for r in range(length, capacity):
            if not left:
                break
            ranges, room[r] = room[r], []
            for first, n in ranges:
                if left:
                    take(first, n, r)
                else:
                    room[r].append((first, n))
        if left:
            n = -(-left // (capacity // length))
            bins, first = bins + n, bins
            take(first, n, capacity)
    return out


def _ranked(cut: DataFrame) -> DataFrame:
    """cut with rank, from 0, of each row within its length: places of (length, hash) come from counts, so frequent lengths are spread."""
    spark = cut.sparkSession
    keys = [c for c in cut.columns if c != "ids"] + (["seal"] if "ids" in cut.columns else [])
    rows = cut.withColumn("seal", F.xxhash64("ids")) if "ids" in cut.columns else cut
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("hash", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sums = rows.groupBy("length", "hash").count()
    before = Window.partitionBy("length").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "hash", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "hash").orderBy(*keys)
    rows = rows.withColumn("place", F.row_number().over(within) - 1).join(sums, ["length", "hash"])
    return rows.withColumn("rank", F.col("before") + F.col("place")).select(*cut.columns, "rank")


def slots(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """length, rank, sequence_id, offset: a slot for each piece, planned from the counts of lengths (at most capacity numbers)."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    made = spark.createDataFrame(plan(counts, capacity), "length int, first_rank long, bins long, per long, first_bin long, first_offset int")
    part = made.withColumn("from", F.explode(F.expr(f"sequence(0L, (bins * per - 1) div {SLOTS})"))).repartition(F.col("length"), F.col("first_rank"), F.col("from"))
    each = part.withColumn("j", F.explode(F.expr(f"sequence(from * {SLOTS}, least(bins * per, (from + 1) * {SLOTS}) - 1)")))
    return each.select("length", (F.col("first_rank") + F.col("j")).alias("rank"), F.expr("first_bin + j div per").alias("sequence_id"), F.expr("cast(first_offset + (j % per) * length as bigint)").alias("offset"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id, offset: best-fit decreasing into sequences of capacity tokens.

    cut: rows of length (1 to capacity) and any other columns that have an order; rows alike in all of them may swap places. An empty table
    gives none. cut is written first, as ranks and counts must see the same rows.
    """
    cut = written(cut, "packing-pieces")
    return _ranked(cut).join(slots(cut, capacity), ["length", "rank"]).select(*cut.columns, "sequence_id", "offset")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of all documents; see pieces() and pack()."""
    rows = pack(pieces(docs, tokenizer, capacity, ids), capacity)
    return rows.withColumn("length", F.col("length").cast("bigint"))


def sequences(packed_rows: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian 32-bit), doc_ids: the sequences themselves, of at most one capacity each; packed_rows with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed_rows.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"), F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"))
