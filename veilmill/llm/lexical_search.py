"""Ranked lexical search by a threshold-seeded join.

1. One pass over the texts makes the index: for each document its length and the counts of those of its terms that the items may hold
   (a bit set of a fixed size says so; exact joins by term come later).
2. A pass over the index stores per term how many documents hold it, its largest impact and its k-th largest one. A
   document's score is at least any one of its impacts, so the largest k-th impact among an item's terms is a
   lower bound of the item's k-th score: the seed of its threshold.
3. An item's terms are put in order of their largest impacts. As soon as all from one on can't reach the threshold together,
   they are pruned: a document that holds only such terms is not among the item's k best. The join is by the other terms.
4. Blocks of items meet all of the index. Documents that share a kept term with an item are its candidates; what they
   have so far, with the bound of the pruned terms, must still reach the threshold, which rises with what a task has found.
   Survivors are rescored exactly over all of the item's terms.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lowered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byteruns import chunks, look_up, runs
from .common import written

K = 10
#: Bits of the set that keeps the terms of items (4 MB whatever the items), and entries (item, term) of a block of items, about.
BITS, ENTRIES = 1 << 25, 1 << 16
#: Documents of the index that a task scores together, and cells (document, item) of its tables.
CELLS = 1 << 22

_TERM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _slots(terms: list[str]) -> np.ndarray:
    """The terms' places in the bit set."""
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % BITS for t in terms], np.int64)


def terms_of(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """first row, row after the last, their terms in order, how many each row has."""
    for first, end, data, offsets in chunks(texts):
        words, each = runs(look_up(data, _LOWER), offsets, look_up(data, _TERM))
        yield first, end, words, each


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, each once. Rows of one item_id (nulls too) are one item, its terms those of all its rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words, each in terms_of(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(first + np.repeat(np.arange(len(each)), each))), words.cast(pa.string())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(task, f"item_id {kind}, term string").distinct()


def _bit_set(terms: DataFrame) -> bytes:
    """BITS bits, with those of all terms set; parts of it are put together by the executors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(batch.column("term").to_pylist()), pa.int64())], ["slot"])

    words = terms.select("term").mapInArrow(task, "slot bigint").select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[found.word.to_numpy(np.int64)] = found.bits.to_numpy(np.int64)
    return bits.tobytes()


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, n, terms, counts: one row per document, with the terms that the bit set of terms lets through."""
    kept = docs.sparkSession.sparkContext.broadcast(_bit_set(terms))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(kept.value, np.uint8)
        for batch in batches:
            for first, end, words, each in terms_of(batch.column("text")):
                coded = words.dictionary_encode()
                slots = _slots(coded.dictionary.to_pylist())
                fine = bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1 == 1
                codes, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(each)), each)
                held = fine[codes] if len(codes) else np.zeros(0, bool)
                keys, counts = np.unique(row[held] * max(1, len(slots)) + codes[held], return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(each) + 1) * max(1, len(slots))), pa.int32())
                names = coded.dictionary.take(pa.array(keys % max(1, len(slots)))).cast(pa.string())
                columns = [batch.column("doc_id").slice(first, end - first), pa.array(each, pa.int64()), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, n bigint, terms array<string>, counts array<bigint>")


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term counts for in a document besides its weight."""
    return 1_000_000_000 * counts // (1_000 * counts + 8 * m)


def _with_m(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows of documents that have a term, with m of each; N."""
    total = rows.where("n > 0").agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    m = F.expr(f"cast(10 + (cast(90 * n as decimal(38,0)) * {total['N']}) div {total['L'] or 1} as bigint)")
    return rows.where("n > 0").withColumn("m", m), total["N"]


def _flat(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of all rows, their impacts without weight, and how many each row has."""
    each = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
    return batch.column("terms").flatten(), impacts(counts, np.repeat(batch.column("m").to_numpy(zero_copy_only=False), each)), each


def term_statistics(rows: DataFrame, k: int = K) -> DataFrame:
    """term, df, most, kth: documents that hold it, and its largest and k-th largest impact without weight (0 if under k documents hold it).

    Each task gives counts and its own k largest, so what meets for a term is bounded by the number of tasks.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[str, int] = {}
        best: dict[str, list[int]] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([best[t] for t in df], pa.list_(pa.int64()))], ["term", "df", "best"])
            df.clear()
            best.clear()
            return out

        for batch in batches:
            terms, impact, _ = _flat(batch)
            coded = terms.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((-impact, codes))
            codes, impact = codes[order], impact[order]
            edges = np.searchsorted(codes, np.arange(len(coded.dictionary) + 1))
            for t, a, b in zip(coded.dictionary.to_pylist(), edges, edges[1:], strict=False):
                df[t] = df.get(t, 0) + int(b - a)
                top = impact[a : min(b, a + k)].tolist()
                best[t] = sorted(best[t] + top, reverse=True)[:k] if t in best else top
            if len(df) > 1_000_000:
                yield told()
        if df:
            yield told()

    part = rows.select("m", "terms", "counts").mapInArrow(task, "term string, df bigint, best array<bigint>")
    met = part.groupBy("term").agg(F.sum("df").alias("df"), F.sort_array(F.flatten(F.collect_list("best")), asc=False).alias("best"))
    return met.select("term", "df", F.col("best")[0].alias("most"), F.coalesce(F.get("best", F.lit(k - 1)), F.lit(0)).alias("kth"))


def weight(df: Column, n: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (F.lit(2.0) * df + 1)))


def seeded(terms: DataFrame, statistics: DataFrame, n: int) -> DataFrame:
    """item_id, threshold, rest, terms array<struct<term, w, kept>>: each item's threshold, its terms, and the bound of those pruned.

    Terms without a document or a weight can't score and are left out, and so are items with no other terms.
    """
    each = terms.join(statistics, "term").withColumn("w", weight(F.col("df"), n)).where("w > 0")
    own = each.groupBy("item_id").agg(F.max(F.col("w") * F.col("kth")).alias("threshold"), F.sort_array(F.collect_list(F.struct((F.col("w") * F.col("most")).alias("bound"), "term", "w"))).alias("t"))
    # From the smallest bound on: terms go as long as their sum stays under the threshold.
    pruned = F.expr("aggregate(t, named_struct('sum', 0L, 'n', 0), (s, x) -> if(s.n >= 0 and s.sum + x.bound < threshold, named_struct('sum', s.sum + x.bound, 'n', s.n + 1), named_struct('sum', s.sum, 'n', if(s.n < 0, s.n, -s.n - 1))), s -> named_struct('sum', s.sum, 'n', if(s.n < 0, -s.n - 1, s.n)))")
    return own.withColumn("p", pruned).select("item_id", "threshold", F.col("p.sum").alias("rest"), F.expr("transform(t, (x, i) -> named_struct('term', x.term, 'w', x.w, 'kept', i >= p.n))").alias("terms"))


def _expanded(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a term each: the row's place and the place in the term's list, for all of each list."""
    n = starts[codes + 1] - starts[codes]
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(codes)), n)
    return row, np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[codes] - (ends - n), n)


class Block:
    """A block of items as arrays: kept and pruned entries by term, and pruned ones by item."""

    def __init__(self, items: list):
        self.threshold = np.array([r["threshold"] for r in items], np.int64)
        self.rest = np.array([r["rest"] for r in items], np.int64)
        names = sorted({t["term"] for r in items for t in r["terms"]})
        place = {t: i for i, t in enumerate(names)}
        self.names = pa.array(names, pa.string())
        entries = np.array([(place[t["term"]], i, t["w"], t["kept"]) for i, r in enumerate(items) for t in r["terms"]], np.int64).reshape(-1, 4)
        self.weight = np.zeros(len(names), np.int64)
        self.weight[entries[:, 0]] = entries[:, 2]
        kept = entries[entries[:, 3] == 1]
        kept = kept[np.argsort(kept[:, 0], kind="stable")]
        self.items, self.starts = kept[:, 1], np.searchsorted(kept[:, 0], np.arange(len(names) + 1))
        pruned = entries[entries[:, 3] == 0]
        pruned = pruned[np.argsort(pruned[:, 1], kind="stable")]
        self.pruned, self.pruned_starts = pruned[:, 0], np.searchsorted(pruned[:, 1], np.arange(len(items) + 1))

    def scores(self, codes: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, item, score of the candidates that reach floor of their item.

        codes: terms' places, in documents' order; sums stay below 2**53, as a block's entries are few.
        """
        n_items = len(self.threshold)
        row, at = _expanded(codes, self.starts)
        cells = docs[row] * n_items + self.items[at]
        so_far = np.bincount(cells, self.weight[codes[row]] * impact[row].astype(np.float64), n_docs * n_items)
        held = np.flatnonzero(so_far > 0)
        doc, item = held // n_items, held % n_items
        alive = so_far[held] + self.rest[item] >= floor[item]
        doc, item, score = doc[alive], item[alive], so_far[held[alive]].astype(np.int64)
        pair, at = _expanded(item, self.pruned_starts)  # what the pruned terms add, met in the document by (document, term)
        keys, order = docs * len(self.names) + codes, None
        order = np.argsort(keys, kind="stable")
        wanted = doc[pair] * len(self.names) + self.pruned[at]
        place = np.minimum(np.searchsorted(keys[order], wanted), max(0, len(keys) - 1))
        if len(keys):
            found = keys[order][place] == wanted
            more = np.where(found, impact[order][place] * self.weight[self.pruned[at]], 0)
            score += np.bincount(pair, more.astype(np.float64), len(doc)).astype(np.int64) if len(pair) else 0
        fine = score >= floor[item]
        return doc[fine], item[fine], score[fine]


def _scored(rows: DataFrame, items: list, k: int) -> DataFrame:
    """item (place in the block), doc_id, score: of each task of rows the k best of each item, or fewer."""
    shared = rows.sparkSession.sparkContext.broadcast([{"threshold": r["threshold"], "rest": r["rest"], "terms": [t.asDict() for t in r["terms"]]} for r in items])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        floor = block.threshold.copy()
        best = None
        for whole in batches:
            step = max(1, CELLS // max(1, len(floor)))
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                terms, impact, each = _flat(batch)
                codes = pc.index_in(terms, block.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                here = codes >= 0
                doc, item, score = block.scores(codes[here], np.repeat(np.arange(len(each)), each)[here], impact[here], len(each), floor)
                new = pa.table({"item": item, "score": score, "doc_id": batch.column("doc_id").take(pa.array(doc))})
                met = new if best is None else pa.concat_tables([best, new])
                met = met.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
                items_of = met["item"].to_numpy()
                place = np.arange(len(items_of)) - np.searchsorted(items_of, items_of)
                best = met.filter(pa.array(place < k))
                full = place == k - 1
                floor[items_of[full]] = np.maximum(floor[items_of[full]], met["score"].to_numpy()[full])
        if best is not None:
            yield from best.select(["item", "doc_id", "score"]).combine_chunks().to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "m", "terms", "counts").mapInArrow(task, f"item bigint, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item, all if fewer.

    docs: doc_id, text; items: item_id, text; other columns are left out. Null texts have no terms. Each row of docs is a document of its
    own, whatever ids repeat; equal scores go by doc_id, nulls last. Rows of one item_id are one item. Items that no document scores for,
    and empty tables, give no rows.
    """
    spark = docs.sparkSession
    terms = written(item_terms(items), "lexical-terms")
    rows = written(index(docs, terms), "lexical-index")
    rows, n = _with_m(rows)
    per_term = written(term_statistics(rows, k), "lexical-statistics")
    own = written(seeded(terms, per_term, n), "lexical-items")
    blocks = (own.agg(F.sum(F.size("terms"))).first()[0] or 0) // ENTRIES + 1
    own = own.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for b in range(blocks):
        some = own.where(F.col("block") == b).collect()  # about ENTRIES entries
        if some:
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"item long, item_id {kind}")
            one = _scored(rows, some, k).join(names, "item").select("item_id", "doc_id", "score")
            found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = written(found, "lexical-found").where("score > 0").withColumn("rank", F.row_number().over(by_score))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
