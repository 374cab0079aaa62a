"""N-gram Jaccard join with prefix filters under several global token orders.

Sets are the distinct 5-word shingles of texts. Two sets that link must share a token among the first
n - ceil(0.8 n) + 1 of either, in whatever order all tokens are put. The join makes use of that with several orders:

1. In hash order, with prefixes longer by c(n), linked sets share c tokens. A set whose prefix meets others in fewer
   tokens has no partner; that rules out most of a corpus from a fraction of its tokens.
2. Among the rest, tokens are counted, and three orders put rare tokens first with different ties. Sets that share a
   prefix token of the first order are candidates; they go on only if they share one under the other orders too.
3. Survivors' intersections are counted exactly.

Equal sets are one node. Sets that share a token are never paired all with all: each round pairs the members of a
token's group with a few leaders, verifies and merges, and later rounds take further leaders for those pairs only that
are still in different components, until no such pair is left. Sets lie in buckets by id and groups in buckets by token,
so that rounds shuffle pairs only; groups whose members are of one component are left behind.

Texts of the second step are fetched once more. A bitmap of bounded size, in which the first filter's survivors set a bit each,
keeps most other texts from being shuffled to them; the exact join follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, written
from .components import components
from .shingles import mix, shingle_sets, slices

WORDS, PERCENT = 5, 80
ORDERS = 3
#: Texts that are packed or unpacked together.
TEXTS = 128
#: Most bits, as a power of two, of the bitmap that is broadcast (8 MB); beyond some 10 million survivors it lets more texts pass.
MOST_BITS = 26


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n that any partner must share: ceil(PERCENT / 100 * n)."""
    return -(-PERCENT * n // 100)


def extra(n: np.ndarray) -> np.ndarray:
    """How many tokens linked sets shall share in the first filter's prefixes."""
    return np.maximum(1, n // 10)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in slices(batch):
            sets, n = shingle_sets(data, offsets, WORDS)
            ends = np.cumsum(n)
            signs = [_sign(sets[e - k : e]) if k else None for k, e in zip(n, ends, strict=True)]
            length = np.where(n > 0, n - least_overlap(n) + extra(n), 0)
            place = np.arange(len(sets)) - np.repeat(ends - n, n)
            prefix = sets[place < np.repeat(length, n)]
            yield pa.record_batch([part.column(0), pa.array(n.astype(np.int64)), pa.array(signs, pa.binary()), _lists(prefix, length)], names=["doc_id", "n_shingles", "sign", "prefix"])
        pa.default_memory_pool().release_unused()


def _sign(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in slices(batch):
            sets, n = shingle_sets(data, offsets, WORDS)
            signs = [_sign(sets[e - k : e]) if k else None for k, e in zip(n, np.cumsum(n), strict=True)]
            yield pa.record_batch([pa.array(signs, pa.binary()), _lists(sets, n)], names=["sign", "tokens"])
        pa.default_memory_pool().release_unused()


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From id, n, dfs, tokens (those that two sets or more have): prefixes under each order; sets without any are left out."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            tokens, once = np.unique(np.array(r["tokens"], np.int64), return_index=True)  # rows that repeat id and text bring them twice
            dfs = np.array(r["dfs"])[once]
            n = r["n"]
            # Tokens that no other set has are the rarest, and fill the front of every prefix.
            length = n - int(least_overlap(np.int64(n))) + 1 - (n - len(tokens))
            if length > 0:
                by_order = []
                for k in range(ORDERS):
                    salted = mix(tokens.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
                    by_order.append(tokens[np.lexsort((salted, dfs))[:length]].tolist())
                out.append({"id": r["id"], "n": n, "tokens": tokens.tolist(), "first": by_order[0], "others": by_order[1:]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("others", pa.list_(pa.list_(pa.int64())))]))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sign (of the whole set; null for none), prefix (in hash order, for the first filter)."""
    return docs.select("doc_id", "text").mapInArrow(_signed, "doc_id bigint, n_shingles bigint, sign binary, prefix array<bigint>")


def _id() -> Column:
    """A set's id: 64 bits of its sign, so that sets are told apart by their tokens, whatever doc_ids repeat."""
    return F.xxhash64("sign").alias("id")


def _survivors(signed: DataFrame) -> DataFrame:
    """id, n, doc_id (the smallest that has it) of each distinct set that meets enough other sets in its prefix."""
    found = signed.where("n_shingles > 0")
    short = F.expr("conv(substr(hex(sign), 1, 15), 16, 10)").cast("bigint")
    postings = found.select(short.alias("e"), F.explode("prefix").alias("token"))
    group = Window.partitionBy("token")
    shared = postings.withColumn("shared", F.min("e").over(group) < F.max("e").over(group)).where("shared").groupBy("e", "token").agg(F.lit(1)).groupBy("e").count()
    sets = found.where("doc_id is not null").groupBy("sign").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")).withColumn("e", short)
    enough = F.expr(f"greatest(1, cast(ceil(n * {PERCENT} / 100) as bigint) div 10)")
    return sets.join(shared, "e").where(F.col("count") >= enough).select(_id(), "n", "doc_id")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text compressed before it is shuffled; a few texts at a time, and freed memory goes back."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            packed = [press.compress(t.as_buffer()) if t.is_valid else None for t in some.column(1)]
            yield pa.record_batch([some.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])
            del packed
        pa.default_memory_pool().release_unused()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            some = batch.slice(at, TEXTS)
            texts = [unpack.decompress(b.as_buffer(), max_output_size=1 << 31) if b.is_valid else None for b in some.column(1)]
            yield pa.record_batch([some.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])
            del texts
        pa.default_memory_pool().release_unused()


def _perhaps(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The texts whose doc_id is chosen (_id), and a few others, whose bit is set too."""
    bits = 1 << min(MOST_BITS, max(15, (16 * chosen.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = chosen.select(place("_id").alias("place")).select(F.bitmap_bucket_number("place").alias("_bucket"), F.bitmap_bit_position("place").alias("bit"))
    bitmaps = marks.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    placed = texts.withColumn("_bucket", F.bitmap_bucket_number(place("doc_id"))).withColumn("_bit", F.bitmap_bit_position(place("doc_id")))
    is_set = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1 = 1")
    return placed.join(F.broadcast(bitmaps), "_bucket").where(is_set).select(texts.columns)


def prefix_sets(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """id, n, tokens, first, others of the surviving sets. Texts of their doc_ids are fetched; of several such texts, those of other sets go."""
    chosen = survivors.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = _perhaps(texts, chosen).mapInArrow(_packed, "doc_id bigint, packed binary").join(chosen, F.col("doc_id") == F.col("_id"), "left_semi")
    tokens = packed.mapInArrow(lambda batches: _full(_unpacked(batches)), "sign binary, tokens array<bigint>").where("sign is not null").select(_id(), F.explode("tokens").alias("token"))
    counted = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    sets = counted.groupBy("id").agg(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "token")).alias("t"))
    sets = sets.join(survivors.select("id", "n"), "id").select("id", "n", F.col("t.df").alias("dfs"), F.col("t.token").alias("tokens"))
    return sets.mapInArrow(_ordered, "id bigint, n bigint, tokens array<bigint>, first array<bigint>, others array<array<bigint>>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: share a prefix token under every other order, and the exact threshold."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"), F.col("others").alias("o_a"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"), F.col("others").alias("o_b"))
    met = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    for k in range(ORDERS - 1):
        met = met.where(F.arrays_overlap(F.col("o_a")[k], F.col("o_b")[k]))
    common = F.size(F.array_intersect("t_a", "t_b"))
    return met.where(100 * common >= PERCENT * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _buckets(df: DataFrame) -> int:
    """As many as there are shuffle partitions, so that what meets buckets is shuffled straight to them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def linked_components(sets: DataFrame) -> DataFrame:
    """node, component of all sets that link to another."""
    spark, n_buckets, group = sets.sparkSession, _buckets(sets), Window.partitionBy("token")
    # Tokens from this one on, of n: what can still be shared if it is the first that is.
    postings = sets.select("id", "n", F.size("tokens").alias("shared"), F.posexplode("first").alias("at", "token"))
    postings = postings.select("id", "n", "token", (F.col("shared") - F.col("at")).alias("from_here"), F.col("id").alias("component"))
    postings = postings.withColumn("rank", F.row_number().over(group.orderBy("id")) - 1)
    postings = postings.withColumn("size", F.count("*").over(group)).where("size > 1")
    open_groups = bucketed(postings, "join-postings", n_buckets, "token")
    labels = spark.createDataFrame([], "node bigint, component bigint")
    low, high, single = 0, 1, True
    while (open_groups.agg(F.max("size")).first()[0] or 0) > low + 1:
        leaders = open_groups.where((F.col("rank") >= low) & (F.col("rank") < high)).select("token", F.col("id").alias("b"), F.col("rank").alias("leader"), F.col("component").alias("of_b"), F.col("n").alias("n_b"), F.col("from_here").alias("from_b"))
        met = open_groups.join(leaders, "token").where("rank > leader and component != of_b")
        # The pair's first common token passes this if the pair links, as no token before it is common.
        pairs = met.where(f"{100 + PERCENT} * least(from_here, from_b) >= {PERCENT} * (n + n_b)").select(F.col("id").alias("a"), "b")
        # First each set meets one leader only, which settles most groups; then every leader.
        pairs = pairs.groupBy("a").agg(F.min("b").alias("b")) if single else pairs.distinct()
        pairs = written(pairs, "join-pairs")
        if pairs.count() and (new := written(verified(pairs, sets), "join-links")).count():
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new))
        if single:
            single = False
        else:
            low, high = high, 16 * high
        # Further leaders have nobody left to meet in groups that are no larger than they rank, or are of one component.
        now = open_groups.where(F.col("size") > low + 1).drop("component").join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
        now = now.withColumn("component", F.coalesce("component", "id")).withColumn("open", F.min("component").over(group) < F.max("component").over(group))
        open_groups = bucketed(now.where("open").drop("open"), "join-open", n_buckets, "token")
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Texts without words, null ones too, have no shingles and are their own component, as is a row without partner; a
    null doc_id has a null component and makes no link. Rows that repeat a doc_id are judged each by its text, and only
    equal or linked texts join their components. Empty docs give an empty result; further columns are ignored. Tokens are 64-bit hashes of shingles.
    """
    signed = written(signatures(docs), "join-signed")
    survivors = written(_survivors(signed), "join-survivors")
    sets = bucketed(prefix_sets(docs, survivors), "join-sets", _buckets(docs), "id")
    found = linked_components(sets)
    classes = signed.where("sign is not null and doc_id is not null").groupBy("sign").agg(F.min("doc_id").alias("least")).withColumn("node", F.xxhash64("sign"))
    # Components are of sets; their names are the smallest doc_ids in them.
    named = written(classes.join(found, "node"), "join-named")
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    classes = classes.join(named, "node", "left").select(F.col("sign").alias("_sign"), F.coalesce("component_id", "least").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "sign").join(classes, F.col("sign") == F.col("_sign"), "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id is the smallest of its component; rows that repeat it stay too."""
    keep = near_duplicates(docs).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
