"""SentencePiece encoding and decoding on a relational lattice.

Texts fall into units that no piece can cross: blanks with the letters, or the other characters, after them. The distinct
units of a corpus are its vocabulary. Each is exploded into substrings of bounded length, these are equi-joined to the
piece table, and the matches, grouped by unit, are the edges of its lattice, which a higher-order aggregate
folds into a segmentation: by Viterbi for unigram models, and for BPE models, whose encoding is no best path, by
merging edges in the order of their scores. A chunk of documents is coded by its own distinct units. A unit meets its uses, one for each chunk that has it, in its
lattice's group and takes them along, so that its ids go straight to these chunks, where texts are put together again: no
task needs the vocabulary, and nothing is joined but pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters that pieces keep apart from all others but blanks in front of them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Units: blanks with the letters after them, a line end, a digit, blanks with the other characters after them, or blanks alone.
UNITS = f"{SPACE}*[{LETTERS}]+|\n|[0-9]|{SPACE}*[^{LETTERS}{SPACE}\n0-9]+|{SPACE}+"
#: Characters of a unit from which merging leaves the fold, whose state is the bits of one long.
FOLD_CHARS = 60
#: Characters of text in a chunk; units that are assembled at a time; encodings that are packed together.
CHUNK_CHARS, BATCH_UNITS, FOUND_ROWS = 20 << 20, 1 << 18, 1 << 18
#: Texts that are cut into words at a time; distinct words that are cut into units at a time.
CHUNK_STEP, UNIT_STEP = 1_024, 1 << 15
#: Documents whose chunks share a vocabulary, which bounds the uses of one unit; documents for which that has a part of its own.
GROUP_DOCS, PART_DOCS = 1 << 25, 2_048
#: Most tasks of a stage; most pieces that may be broadcast.
MOST_TASKS, MOST_PIECES = 100_000, 300_000
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """The piece table of a model file."""

    kind: int
    pieces: list[str]
    scores: list[float]
    special: list[bool]
    byte_ids: list[int]
    unknown: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            data = f.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        kind, normalizer = UNIGRAM, {1: b"identity", 3: 1, 4: 1, 5: 1}
        for field, value in _fields(data):
            if field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            if field == 3:
                normalizer |= dict(_fields(value))
        if normalizer[1] != b"identity" or not normalizer[3] or normalizer[4] or not normalizer[5]:
            raise ValueError("only models are supported that keep texts as they are and put a blank in front")
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        plain = [p for p, s in zip(pieces, special, strict=True) if not s]
        if n > MOST_PIECES or any(len(re.findall(UNITS, p)) != 1 for p in plain):
            raise ValueError("a piece of this model crosses the ends of units")
        at = {p: i for i, p in enumerate(pieces)}
        byte_ids = [at[f"<0x{b:02X}>"] for b in range(256)] if "<0x00>" in at else []
        return cls(kind, pieces, [model.get_score(i) for i in range(n)], special, byte_ids, model.unk_id())

    @property
    def longest(self) -> int:
        return max(len(p) for p, s in zip(self.pieces, self.special, strict=True) if not s)

    @property
    def fold_chars(self) -> int:
        """Characters of the longest unit that the fold takes."""
        return 2**31 - 1 if self.kind == UNIGRAM else FOLD_CHARS

    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if not self.special[i]}

    def late(self) -> set[str]:
        """Pieces that consist of two symbols, pieces or single characters, of which one has no better score than the whole."""
        score = {p: self.scores[i] for p, i in self.ids().items()}
        of = lambda s: score.get(s) if len(s) > 1 else float("inf")
        splits = lambda p: ((of(p[:k]), of(p[k:])) for k in range(1, len(p)))
        return {p for p in score if any(a is not None and b is not None and min(a, b) <= score[p] for a, b in splits(p))}


#: A BPE edge is one long: the rank of its cost, its start, its size, whether it may come late, and its id, from the top.
RANK, START, SIZE, LATE = 40, 32, 24, 23
#: Characters under this code point, and the mark of blanks, have their ids in an array; all others are edges.
DIRECT = 0x250


def lattice(vocabulary: DataFrame, table: Pieces) -> DataFrame:
    """part, unit, n (its characters), uses, edges, best score first and then from the left.

    Edges are structs of cost, start, stop and id for unigram models, longs for BPE models, whose order of costs is all that counts.
    vocabulary (part, unit, uses) is partitioned by part, and all of this stays in its partitions. In unigram models every
    character has an edge, also where it is no piece; in BPE models those pieces of one character that DIRECT leaves out.
    Substrings of three characters and more are exploded in those lengths only that pieces with their first three characters have.
    """
    spark = vocabulary.sparkSession
    bpe = table.kind != UNIGRAM
    rows = [(p, i, float(s)) for i, (p, s, x) in enumerate(zip(table.pieces, table.scores, table.special, strict=True)) if not x]
    rank = {s: k for k, s in enumerate(sorted({s for _, _, s in rows}, reverse=True))}
    late = table.late() if bpe else set()
    heads: dict[str, set[int]] = defaultdict(set)
    for p, _, _ in rows:
        if len(p) > 2:
            heads[p[:3]].add(len(p))
    pieces = F.broadcast(spark.createDataFrame([(*r, rank[r[2]] << RANK | (r[0] in late) << LATE | r[1]) for r in rows], "piece string, id int, score double, ranked bigint"))
    sizes = F.broadcast(spark.createDataFrame([(h, sorted(x)) for h, x in heads.items()] or [("", [])], "head string, sizes array<int>"))
    # Numbers of units grow along a task, so edges come to their groups in order. One row of each unit, of size 0, carries it and its uses.
    units = vocabulary.select(F.monotonically_increasing_id().alias("key"), "part", "unit", F.length("unit").alias("n"), "uses")
    starts = units.select("*", F.explode(F.expr("sequence(0, n - 1)")).alias("start")).withColumn("head", F.expr("substr(unit, start + 1, 3)")).join(sizes, "head", "left")
    direct = f"(ascii(head) < {DIRECT} or ascii(head) = {ord(SPACE)})" if bpe else "false"
    short = f"if(start = 0, if({direct}, array(0, 2), array(0, 1, 2)), if({direct}, array(2), array(1, 2)))"
    parts = starts.select("*", F.explode(F.expr(f"if(sizes is null, {short}, concat({short}, sizes))")).alias("size")).where("start + size <= n")
    first = F.col("size") == 0
    parts = parts.select("key", "part", F.when(first, F.col("unit")).alias("unit"), F.when(first, F.col("uses")).alias("uses"), "start", "size", F.expr("substr(unit, start + 1, size)").alias("piece"))
    edges = parts.join(pieces, "piece", "left").where("id is not null or size = 0" + ("" if bpe else " or size = 1"))
    if bpe:
        edge = F.expr(f"ranked | shiftleft(cast(start as bigint), {START}) | shiftleft(cast(size as bigint), {SIZE})")
    else:
        unseen = min(score for _, _, score in rows) - 10.0
        edge = F.when(~first, F.struct((-F.coalesce("score", F.lit(unseen))).alias("cost"), "start", (F.col("start") + F.col("size")).alias("stop"), "id"))
    together = edges.groupBy("key", "part").agg(F.sort_array(F.collect_list(edge)).alias("edges"), F.first("unit", ignorenulls=True).alias("unit"), F.first("uses", ignorenulls=True).alias("uses"))
    return together.select("part", "unit", F.length("unit").alias("n"), "uses", "edges")


def _bytes_of(character: str, table: Pieces) -> str:
    """SQL for the ids of a character that is no piece: its bytes' pieces, or the unknown one."""
    if not table.byte_ids:
        return f"array({table.unknown})"
    return f"transform(sequence(0, octet_length({character}) - 1), b -> array({', '.join(map(str, table.byte_ids))})[cast(conv(substr(hex(encode({character}, 'utf-8')), 2 * b + 1, 2), 16, 10) as int)])"


def merged(edges: DataFrame, table: Pieces) -> DataFrame:
    """part, unit, uses, ids by BPE: again and again the best edge over exactly two symbols becomes one symbol.

    The state is the set of symbol ends, one bit each. An edge applies if its ends are symbol ends and one more
    lies between them. One pass over the edges, best first, is enough as long as no merge makes an earlier edge apply; that
    can be an edge only that consists of two symbols of which one is no better than itself, and these are marked as late. Where a late edge
    comes to apply after its turn, the unit is folded again, from the best edge on after each merge.
    """
    start, size = (lambda e, at=at: f"cast(shiftright({e}, {at}) & 255 as int)" for at in (START, SIZE))
    #: The symbol ends from an edge's start to its stop, the first one lowest.
    ends = lambda m, e: f"shiftrightunsigned({m}, {start(e)}) & (shiftleft(2L, {size(e)}) - 1)"
    applies = lambda m, e: f"exists(array({ends(m, e)}), w -> bit_count(w) = 3 and (w & 1) = 1 and shiftright(w, {size(e)}) = 1)"
    without = lambda m, e: f"({m} & ~shiftleft(shiftleft(1L, {size(e)} - 1) - 1, {start(e)} + 1))"
    none = "shiftleft(1L, n + 1) - 1"
    # transform(array(x), v -> ...)[0] binds x to v, so that no lambda computes it again for each of its elements. A negative state is one that a late edge has spoilt.
    after = f"transform(array({without('m', 'e')}), k -> if(exists(late, l -> l < e and {applies('k', 'l')}), -1L, k))[0]"
    once = f"transform(array(filter(edges, e -> (e & {1 << LATE}) != 0)), late -> aggregate(edges, {none}, (m, e) -> if(m >= 0 and {applies('m', 'e')}, {after}, m)))[0]"
    again = f"aggregate(sequence(1, greatest(1, n - 1)), {none}, (m, i) -> transform(array(get(filter(edges, e -> {applies('m', 'e')}), 0)), e -> if(e is null, m, {without('m', 'e')}))[0])"
    state = edges.withColumn("m", F.expr(f"transform(array({once}), m -> if(m >= 0, m, {again}))[0]"))
    # What edges and single characters are symbols at the end, as start, place in it and id, in order.
    known = table.ids()
    codes = f"array({', '.join(str(known.get(chr(c), -1)) for c in [*range(DIRECT), ord(SPACE)])})"
    one = "substr(unit, i + 1, 1)"
    id_of = f"transform(array(ascii({one})), c -> if(c < {DIRECT}, {codes}[c], if(c = {ord(SPACE)}, {codes}[{DIRECT}], -1)))[0]"
    place = lambda at, k, i: f"shiftleft(cast({at} as bigint), {RANK}) | shiftleft(cast({k} as bigint), {START}) | {i}"
    taken = f"transform(filter(edges, e -> ({ends('m', 'e')}) = shiftleft(1L, {size('e')}) + 1), e -> {place(start('e'), 0, f'e & {(1 << LATE) - 1}')})"
    alone = "filter(sequence(0, n - 1), i -> (shiftrightunsigned(m, i) & 3) = 3)"
    spelled = f"if(exists(edges, e -> {size('e')} = 1 and {start('e')} = i), cast(array() as array<bigint>), transform({_bytes_of(one, table)}, (x, k) -> {place('i', 'k', 'x')}))"
    single = f"flatten(transform({alone}, i -> transform(array({id_of}), c -> if(c >= 0, array({place('i', 0, 'c')}), {spelled}))[0]))"
    ids = f"transform(sort_array(concat({taken}, {single})), x -> cast(x & {(1 << LATE) - 1} as int))"
    return state.select("part", "unit", "uses", F.expr(ids).alias("ids"))


def _character_ids(table: Pieces) -> str:
    """SQL for the ids by position of a unit's single characters in a unigram lattice."""
    return f"transform(array_sort(filter(edges, x -> x.stop = x.start + 1), (l, r) -> l.start - r.start), x -> if(x.id is null, {_bytes_of('substr(unit, x.start + 1, 1)', table)}, array(x.id)))"


def viterbi(edges: DataFrame, table: Pieces) -> DataFrame:
    """part, unit, uses, ids on the best path: one fold over positions keeps the best cost, edge and id up to each, another goes back."""
    step = "struct(path[x.start].cost + x.cost as cost, x.start as start, x.id as id)"
    path = f"aggregate(sequence(1, n), array(struct(0D as cost, -1 as start, cast(null as int) as id)), (path, e) -> concat(path, array(array_min(transform(filter(edges, x -> x.stop = e), x -> {step})))))"
    back = "aggregate(sequence(1, n), struct(n as at, cast(array() as array<array<int>>) as ids), (s, i) -> if(s.at = 0, s, struct(v.path[s.at].start as at, concat(array(if(v.path[s.at].start = s.at - 1, v.chars[s.at - 1], array(v.path[s.at].id))), s.ids) as ids)), s -> flatten(s.ids))"
    return edges.select("part", "unit", "uses", F.expr(f"transform(array(struct({path} as path, {_character_ids(table)} as chars)), v -> {back})[0]").alias("ids"))


def merge_long(unit: str, ids: dict[str, int], scores: list[float], table: Pieces) -> list[int]:
    """The same merges for one long unit, on a heap: n log n in its length."""
    left, right = list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
    symbols, heap = list(unit), []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0 and (found := ids.get(symbols[i] + symbols[right[i]])) is not None:
            heapq.heappush(heap, (-scores[found], i, symbols[i] + symbols[right[i]]))

    for i in range(len(unit)):
        offer(i)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = right[i]
        if not symbols[i] or j < 0 or symbols[i] + symbols[j] != whole:
            continue
        symbols[i], symbols[j] = whole, ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    out: list[int] = []
    for s in symbols:
        if s:
            out += [ids[s]] if s in ids else [table.byte_ids[b] for b in s.encode()] if table.byte_ids else [table.unknown]
    return out


def encode_units(vocabulary: DataFrame, table: Pieces) -> DataFrame:
    """part, unit, uses, ids of distinct units (part, unit, uses), partitioned as vocabulary is."""
    return (viterbi if table.kind == UNIGRAM else merged)(lattice(vocabulary, table), table)


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _gathered(first: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The positions of the lists that which names, end to end, if list i has sizes[i] positions from first[i] on."""
    n = sizes[which]
    upto = _ends(n)
    return np.arange(upto[-1]) + np.repeat(first[which] - upto[:-1], n)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """The words of texts, those of texts that are one run of words between single blanks first, and the order of texts so."""
    odd = [pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.equal(texts, "")]
    odd = np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in odd])
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    # A blank begins a unit, unless several stand together, which then begin one; a text is its words but for these.
    split = lambda text: [m[1:] for m in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))] if text else []
    rest = pa.array([split(x) for x in texts.filter(pa.array(odd)).to_pylist()], plain.type)
    return np.argsort(odd, kind="stable"), pa.concat_arrays([plain, rest]) if len(rest) else plain


class _Chunk:
    """Texts as codes of the units that they have, by way of their words: each distinct word is cut into units once."""

    def __init__(self):
        self.keys, self.words, self.size = [], [], 0

    def add(self, keys: pa.Array, texts: pa.Array) -> int:
        """Takes the first of these rows, as far as they fill the chunk, and tells how many they are."""
        upto = self.size + np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 32)
        n = min(len(texts), int(np.searchsorted(upto, CHUNK_CHARS)) + 1)
        for i in range(0, n, CHUNK_STEP):
            order, words = _words(texts.slice(i, min(CHUNK_STEP, n - i)))
            self.keys.append(keys.slice(i, len(order)).take(pa.array(order)))
            self.words.append(words)
        self.size = int(upto[n - 1])
        return n

    def row(self, groups: int, parts: int, where: bytes) -> pa.RecordBatch:
        """The chunk as one row: texts as codes of its units, frequent ones having small codes, and the units by part."""
        spell, at = re.compile(UNITS), defaultdict(count().__next__)
        counts = [w.value_lengths().to_numpy() for w in self.words]
        coded = pa.chunked_array([w.flatten() for w in self.words]).dictionary_encode()
        self.words.clear()
        # Arrow leaves out what has no words, as where all texts of a step are empty.
        encoded = iter(coded.chunks)
        words = [next(encoded).indices.to_numpy() if n.any() else np.zeros(0, np.int32) for n in counts]
        distinct = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.string())
        del coded, encoded
        sizes, flat = np.zeros(len(distinct), np.int64), array("i")
        for i in range(0, len(distinct), UNIT_STEP):
            some = distinct.slice(i, UNIT_STEP).to_pylist()
            found = spell.findall(SPACE + SPACE.join(some))
            heads = np.flatnonzero(np.fromiter((u[0] == SPACE for u in found), bool, len(found)))
            if len(heads) == len(some):
                sizes[i : i + len(some)] = np.diff(heads, append=len(found))
            else:  # a word of blanks only has run into the next one
                each = [spell.findall(SPACE + w) for w in some]
                sizes[i : i + len(some)] = [len(x) for x in each]
                found = [u for x in each for u in x]
            flat.extend(map(at.__getitem__, found))
        del distinct
        of_word = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
        first = _ends(sizes)[:-1]
        code, n_units, done = np.empty(sum(int(sizes[w].sum()) for w in words), np.int32), [], 0
        for w, n in zip(words, counts, strict=True):
            upto = _ends(sizes[w])
            code[done : done + upto[-1]] = of_word[_gathered(first, sizes, w)]
            n_units.append(np.diff(upto[_ends(n)]))
            done += upto[-1]
        units = list(at)
        order = np.argsort(-np.bincount(code, minlength=len(units)), kind="stable")
        rank = np.empty(len(units), np.int32)
        rank[order] = np.arange(len(units), dtype=np.int32)
        for i in range(0, len(code), BATCH_UNITS):
            code[i : i + BATCH_UNITS] = rank[code[i : i + BATCH_UNITS]]
        # Bytes of one weight stand together, which compresses best.
        planes = code.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4)
        planes = pa.record_batch({f"b{k}": pa.array([planes[:, k].tobytes()], pa.large_binary()) for k in range(4)})
        rows = pa.record_batch({"key": pa.concat_arrays(self.keys), "n": pa.array(np.concatenate(n_units).astype(np.int64))})
        part = np.fromiter((zlib.crc32(u.encode()) for u in units), np.int64, len(units)) % parts + zlib.crc32(where) % groups * parts
        named = pa.record_batch({"unit": pa.array(units, pa.string()), "part": pa.array(part), "code": pa.array(rank)})
        named = named.take(pc.sort_indices(named.column("unit")))
        packed = [_to_bytes(x) for x in (planes, rows, named)]
        name = hashlib.blake2b(where + b"".join(packed), digest_size=8).digest()
        body = pa.array([{"codes": packed[0], "rows": packed[1], "units": packed[2]}], pa.struct([("codes", pa.binary()), ("rows", pa.binary()), ("units", pa.binary())]))
        return pa.record_batch([pa.array([int.from_bytes(name, "little", signed=True)], pa.int64()), pa.array([_to_bytes(pa.RecordBatch.from_struct_array(body))], pa.binary())], names=["chunk", "packed"])


def _chunked(groups: int, parts: int):
    """From key, text: chunks of about CHUNK_CHARS of text (one text at least), each one row chunk, packed."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_chunks, chunk = count(), _Chunk()
        where = lambda: b"%d.%d." % (TaskContext.get().partitionId(), next(n_chunks))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.string())
            while len(keys):
                n = chunk.add(keys, texts)
                keys, texts = keys.slice(n), texts.slice(n)
                if chunk.size >= CHUNK_CHARS:
                    yield chunk.row(groups, parts, where())
                    chunk = _Chunk()
                    pa.default_memory_pool().release_unused()
        if chunk.keys:
            yield chunk.row(groups, parts, where())
            pa.default_memory_pool().release_unused()

    return chunks


def _units_by_part(most: int):
    """From chunk, packed: part, chunk, units (in order, between line ends; "" for the line end), codes: the chunk's units of each part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                named = _from_bytes(_from_bytes(packed.as_buffer()).column("units")[0].as_buffer())
                named = named.filter(pc.less_equal(pc.utf8_length(named.column("unit")), most))
                named = named.take(pa.array(np.argsort(named.column("part").to_numpy(), kind="stable"))).combine_chunks()
                heads = np.flatnonzero(np.diff(named.column("part").to_numpy(), prepend=-1))
                ends = np.append(heads, named.num_rows)
                units = ["" if u == "\n" else u for u in named.column("unit").to_pylist()]
                units = pa.array(["\n".join(units[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
                codes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), named.column("code").combine_chunks())
                yield pa.record_batch([named.column("part").combine_chunks().take(pa.array(heads)), pa.array([chunk] * len(heads), pa.int64()), units, codes], names=["part", "chunk", "units", "codes"])

    return deal


def _planes(x: np.ndarray) -> bytes:
    x = x.astype("<u4")
    return x.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    return np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel(), at + 4 * n


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunk, code, ids: chunk, found: the encodings of the units of one chunk, packed, as many as come together in FOUND_ROWS."""
    press = zstandard.ZstdCompressor(level=3)
    held: list[pa.RecordBatch] = []
    rows = 0

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        chunk, code = table.column("chunk").to_numpy(), table.column("code").to_numpy()
        lists = table.column("ids").combine_chunks()
        sizes, values = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        order = np.lexsort((code, chunk))
        chunk, code = chunk[order], code[order]
        values, sizes = values[_gathered(_ends(sizes)[:-1], sizes, order)], sizes[order]
        heads = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1)) if len(chunk) else np.zeros(0, np.int64)
        cuts, upto, out = np.append(heads, len(chunk)), _ends(sizes), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            head = np.array([b - a, upto[b] - upto[a]], "<i8").tobytes()
            out.append(press.compress(head + _planes(np.diff(code[a:b], prepend=0)) + _planes(sizes[a:b]) + _planes(values[upto[a] : upto[b]])))
        return pa.record_batch([pa.array(chunk[heads]), pa.array(out, pa.binary())], names=["chunk", "found"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FOUND_ROWS:
            yield packed()
            held, rows = [], 0
    if rows:
        yield packed()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """code, sizes, ids of what _found packed."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, total = np.frombuffer(raw, "<i8", 2)
    code, at = _from_planes(raw, int(n), 16)
    sizes, at = _from_planes(raw, int(n), at)
    values, _ = _from_planes(raw, int(total), at)
    return np.cumsum(code.astype(np.int64)), sizes.astype(np.int64), values.astype(np.int32)


def _spelled(table: Pieces) -> list[bytes]:
    """The bytes that each id stands for, blanks for their marks; control pieces stand for none."""
    of_bytes = set(table.byte_ids)
    special = lambda i, p: bytes([int(p[3:5], 16)]) if i in of_bytes else " ⁇ ".encode() if i == table.unknown else b""
    return [special(i, p) if table.special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(table.pieces)]


def decode_ids(ids: list[int], spelled: list[bytes]) -> str:
    """The text of ids, without the blank in front."""
    return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _assembled(key: str, table: Pieces):
    """From packed, found (the encodings of the chunk's units): key, ids, n_units of each of the chunk's rows, and the SHA-256 of
    the text that its ids decode to.

    The few units that are too long for the fold, one in each chunk that has it, are merged here.
    """

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_ids, spelled = table.ids(), _spelled(table)
        for batch in batches:
            for packed, found in zip(*batch.columns, strict=True):
                # Parts are read one after the other, without copies: chunks are large.
                body = _from_bytes(packed.as_buffer())
                rows, named = (_from_bytes(body.column(c)[0].as_buffer()) for c in ("rows", "units"))
                n_units, named = named.num_rows, named.filter(pc.greater(pc.utf8_length(named.column("unit")), table.fold_chars))
                planes = _from_bytes(body.column("codes")[0].as_buffer())
                code = np.empty(len(planes.column("b0")[0].as_buffer()), "<i4")
                for k in range(4):
                    code.view(np.uint8).reshape(-1, 4)[:, k] = np.frombuffer(planes.column(f"b{k}")[0].as_buffer(), np.uint8)
                del body, planes
                pa.default_memory_pool().release_unused()
                long = named.to_pylist()
                merged_long = [merge_long(r["unit"], piece_ids, table.scores, table) for r in long]
                pieces = [_unpacked(x.as_py()) for x in (found.values if found.is_valid else ())]
                pieces.append((np.array([r["code"] for r in long], np.int64), np.array([len(x) for x in merged_long], np.int64), np.array([i for x in merged_long for i in x], np.int32)))
                own, sizes, values = (np.concatenate([p[i] for p in pieces]) for i in range(3))
                del pieces
                length, first = np.full(n_units, -1, np.int32), np.zeros(n_units, np.int32)
                length[own], first[own] = sizes, _ends(sizes)[:-1]
                if (length < 0).any():
                    raise RuntimeError("a chunk's units are not all encoded: the rows of a recomputed task differ from those of its first run")
                ends = _ends(rows.column("n").to_numpy())
                at = 0
                while at < rows.num_rows:
                    stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_UNITS, "right")) - 1)
                    mine = code[ends[at] : ends[stop]]
                    upto = _ends(length[mine])
                    part = rows.slice(at, stop - at)
                    ids, cuts = values[_gathered(first, length, mine)], upto[ends[at : stop + 1] - ends[at]]
                    digests = [hashlib.sha256(decode_ids(ids[a:b].tolist(), spelled).encode()).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))
                    yield pa.record_batch([part.column("key").combine_chunks(), lists, part.column("n").combine_chunks(), pa.array(digests, pa.string())], names=[key, "ids", "n_units", "decoded_sha256"])
                    at = stop
                del rows, named, code, own, sizes, values, length, first, ids, lists
                pa.default_memory_pool().release_unused()

    return assemble


def encode(docs: DataFrame, table: Pieces, key: str = "doc_id") -> DataFrame:
    """key (a column of whole numbers), ids array<int>, n_units, decoded_sha256 for each row of docs.

    A null text is encoded as an empty one: no ids. Null keys and rows that repeat are encoded each. Empty docs give an
    empty result; further columns are ignored.

    docs is to be a scan, or another frame whose tasks give the same rows when they are run again: chunks are computed
    once and lie in shuffle files; where these are lost and computed anew from other rows, the job fails.
    """
    n = docs.count()
    groups, parts = n // GROUP_DOCS + 1, min(n, GROUP_DOCS) // PART_DOCS + 2
    tasks = min(groups * parts, MOST_TASKS)
    rows = docs.select(F.col(key).cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Texts move once, as codes of their chunk's units. Both uses below read this one exchange.
    chunks = rows.mapInArrow(_chunked(groups, parts), "chunk bigint, packed binary").repartition(tasks, "chunk")
    dealt = chunks.mapInArrow(_units_by_part(table.fold_chars), "part bigint, chunk bigint, units string, codes array<int>").repartition(tasks, "part")
    used = dealt.select("part", "chunk", F.explode(F.arrays_zip(F.split("units", "\n", -1).alias("units"), "codes")).alias("u"))
    used = used.select("part", F.when(F.col("u.units") == "", "\n").otherwise(F.col("u.units")).alias("unit"), F.struct("chunk", F.col("u.codes").alias("code")).alias("use"))
    vocabulary = used.groupBy("unit", "part").agg(F.collect_list("use").alias("uses"))
    encoded = encode_units(vocabulary, table).select("ids", F.explode("uses").alias("use")).select("use.chunk", "use.code", "ids")
    found = encoded.select("chunk", "code", "ids").mapInArrow(_found, "chunk bigint, found binary").repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list("found").alias("found"))
    both = chunks.join(found.hint("merge"), "chunk", "left").select("packed", "found")
    return both.mapInArrow(_assembled(key, table), f"{key} bigint, ids array<int>, n_units bigint, decoded_sha256 string")


def decoded(rows: DataFrame, table: Pieces, ids: str = "ids") -> DataFrame:
    """rows with text, what their ids decode to; null for null ids."""

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spelled = _spelled(table)
        for batch in batches:
            yield pd.Series([None if x is None else decode_ids(list(x), spelled) for x in batch], dtype=object)

    return rows.withColumn("text", spell(ids))


def encode_decode(docs: DataFrame, table: Pieces) -> DataFrame:
    """doc_id, n_units, n_pieces, ids, decoded_sha256 (of the text that decoding the ids gives, UTF-8, lowercase hex)."""
    return encode(docs, table).select("doc_id", "n_units", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "decoded_sha256")
