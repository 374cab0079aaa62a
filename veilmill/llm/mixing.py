"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents, in hash order, form a stream of words, repeated as often as its target asks; the stream is cut
into blocks of equally many words. Slot t of the schedule belongs to the source in whose stretch of the cumulative
weights the t-th golden-ratio point falls, and takes that source's next block: slots are ranked per source, and joined
to blocks by rank. So each prefix of the schedule is mixed in the target weights to within a few blocks.

Ranks and running sums are taken in two levels, within short runs and over the runs' totals, so that a source with most
of the rows is spread over many tasks. What is mixed is partitioned by stretches of the schedule, so that texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, word_array, written

#: Weights by place of the source in code point order, repeating; the mix's share of all words; most repeats of a source.
WEIGHTS, SHARE, MOST_REPEATS = (5, 2, 1), 1.5, 2
#: Words in a block.
BLOCK_WORDS = 128
#: Slots, or documents, that one run of the two-level ranks holds on average.
RUN_ROWS = 16_384
#: An odd whole number near 2**31 divided by the golden ratio; its multiples modulo 2**31 are the points.
GOLDEN, POINTS = 1_327_217_885, 1 << 31


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, doc_id, source, size (words of the text)."""
    return docs.select(*keep, "doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: place (from 1), source, source_size, target, low and high end of its cumulative weight in 0 to 1.

    Targets share SHARE times all words by WEIGHTS; one that would pass MOST_REPEATS times its source's size stops there
    and the others share the rest. With sources in order of size over weight, those that stop come first: the share per
    weight that is left only rises, so the first source below its limit settles the level for all after it.
    """
    by_place = Window.orderBy(F.asc_nulls_last("source"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.expr(f"int(place - 1) % {len(WEIGHTS)} + 1"))
    rows = rows.withColumn("place", F.row_number().over(by_place)).withColumn("weight", weight.cast("double"))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(MOST_REPEATS)))
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(everyone) * F.lit(SHARE) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
    rows = rows.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))).over(everyone)["level"])
    rows = rows.withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
    total = F.sum("target").over(everyone)
    high = F.sum("target").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("high", F.when(total > 0, high / total).otherwise(0.0))
    return rows.select("place", "source", "source_size", "target", F.col("high") - F.when(total > 0, F.col("target") / total).otherwise(0.0), "high").toDF("place", "source", "source_size", "target", "low", "high")


def _ranked(rows: DataFrame, key: str, run: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount over all rows of the same key before each, by run and then by order."""
    rows = rows.withColumn("_amount", amount)
    totals = rows.groupBy(key, run).agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(key).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(key), F.col(run), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(key, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    return rows.join(offsets, [key, run]).withColumn(name, (F.col("_offset") + F.col("_within")).cast("bigint")).drop("_amount", "_offset", "_within")


def schedule(sources: DataFrame) -> DataFrame:
    """slot, place, rank of the slot in its source, and the words [first_word, end_word) of the source's repeated stream.

    As many slots as all targets need and 1/64 more, of which each source uses as many as it needs. What a source
    still lacks then, as one with a stretch so short that no point fell in it, comes at the end.
    """
    need = sources.agg(F.sum(F.ceil(F.round("target") / BLOCK_WORDS)).alias("n"), F.count("*").alias("k")).first()
    slots, k = int(need["n"] or 0), need["k"]
    slots += slots // 64 + 64 * (k + 1) if slots else 0
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), ((((F.col("id") + 1) % POINTS) * GOLDEN) % POINTS / float(POINTS)).alias("point"))
    # A grid turns the search of the stretch that holds a point into an equi-join; it has as many cells as sources, and more.
    grid = 1 << max(6, (4 * k).bit_length())
    stretches = sources.where("high > low").select("place", "target", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * grid), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)))).alias("cell"))
    found = points.withColumn("cell", F.floor(F.col("point") * grid)).join(stretches, "cell").where("point >= low and point < high")
    found = found.select("slot", "place", "target", F.floor(F.col("slot") / RUN_ROWS).alias("run"))
    found = written(_ranked(found, "place", "run", ["slot"], F.lit(1), "rank").select("slot", "place", "rank", "target"), "mix-slots")
    needs = sources.select("place", "target", F.ceil(F.round("target") / BLOCK_WORDS).alias("need")).join(found.groupBy("place").agg(F.count("*").alias("have")), "place", "left")
    lacking = needs.withColumn("have", F.coalesce("have", F.lit(0))).where("have < need").select("place", "target", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    found = found.unionByName(lacking.select((F.lit(slots) + F.col("place") - 1 + F.col("rank") * k).alias("slot"), "place", "rank", "target"))
    first, end = F.col("rank") * BLOCK_WORDS, F.least((F.col("rank") + 1) * BLOCK_WORDS, F.round("target").cast("bigint"))
    return found.select("slot", "place", "rank", first.alias("first_word"), end.alias("end_word")).where("first_word < end_word")


def _hash(doc_id: str) -> Column:
    return F.xxhash64(doc_id, F.lit("mix"))


def _runs(sizes: DataFrame) -> int:
    return max(1, sizes.count() // RUN_ROWS)


def streams(sizes: DataFrame, sources: DataFrame, ties: tuple[str, ...] = ("size", "row"), keep: tuple[str, ...] = ()) -> DataFrame:
    """row, doc_id, place, size, source_size, target, offset and keep of each row of sizes in its source's stream, in order of hashes, doc_ids and ties."""
    rows = sizes.withColumn("hash", _hash("doc_id")).withColumn("run", F.pmod("hash", F.lit(_runs(sizes))))
    rows = rows.join(sources.select(F.col("source").alias("_source"), "place", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    rows = _ranked(rows, "place", "run", ["hash", "doc_id", *ties], F.col("size"), "offset")
    return rows.select("row", "doc_id", "place", "size", "source_size", "target", "offset", *keep)


def block_parts(rows: DataFrame) -> DataFrame:
    """row, turn (0 when the stream first passes), its start in the stream, place, rank of a block, and the stream's words that the row has in that block."""
    turns = rows.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))).alias("turn"))
    turns = turns.withColumn("start", F.col("offset") + F.col("turn") * F.col("source_size")).where("start < target")
    turns = turns.withColumn("end", F.col("start") + F.col("size"))
    cut = turns.select("*", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("end") - 1) / BLOCK_WORDS))).alias("rank"))
    return cut.select("row", "turn", "start", "place", "rank", F.greatest("start", F.col("rank") * BLOCK_WORDS).alias("from_word"), F.least("end", (F.col("rank") + 1) * BLOCK_WORDS).alias("to_word"))


def taken_parts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """row, turn, slot, at (words of the row before), words: what each slot of the schedule takes from each row."""
    parts = block_parts(rows).join(schedule(sources), ["place", "rank"])
    return parts.select("row", "turn", "slot", (F.col("from_word") - F.col("start")).alias("at"), (F.least("to_word", "end_word") - F.col("from_word")).alias("words")).where("words > 0")


def _prepared(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    sources = written(targets(sizes), "mix-sources")
    return written(streams(sizes, sources), "mix-streams"), sources


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null where nothing is taken) for each row of docs.

    Null texts have size 0 and are never taken; null sources are one source, last in order. Rows that repeat are taken
    one by one; their doc_id may be null. Empty docs give an empty result, and docs without any word targets of 0.
    Further columns are ignored.
    """
    rows, sources = _prepared(written(sized(docs).withColumn("row", F.monotonically_increasing_id()), "mix-sizes"))
    taken = taken_parts(rows, sources).groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot")


def blocks(docs: DataFrame) -> DataFrame:
    """slot, doc_id, turn, first_word (words of the text before), text: the mixed stream, in order of slots.

    What a slot takes of one document is a row, its words one blank apart; within a slot rows are in order of the source's stream.
    """
    docs = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text"), "mix-docs")
    rows, sources = _prepared(written(sized(docs, "row"), "mix-sizes"))
    parts = taken_parts(rows, sources).join(rows.select("row", "offset"), "row").groupBy("row", "offset").agg(F.collect_list(F.struct("slot", "turn", "at", "words")).alias("parts"))
    # Words are parted once for all parts of a row.
    held = docs.join(parts.hint("merge"), "row").select("doc_id", "offset", "parts", word_array(F.col("text")).alias("w"))
    cut = F.transform("parts", lambda p: F.struct(p["slot"].alias("slot"), p["turn"].alias("turn"), p["at"].alias("first_word"), F.array_join(F.slice(F.col("w"), (p["at"] + 1).cast("int"), p["words"].cast("int")), " ").alias("text")))
    return held.select("doc_id", "offset", F.explode(cut).alias("p")).orderBy("p.slot", "p.turn", "offset", "p.first_word").select("p.slot", "doc_id", "p.turn", "p.first_word", "p.text")


def _seal(docs: DataFrame) -> Column:
    """A hash of all columns, nulls too: with the doc_id it tells rows apart, and rows that it doesn't tell apart are the same."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def _turns(sizes: DataFrame) -> DataFrame:
    """source, run, hash, doc_id, seal, turn, first_slot, stretch (of RUN_ROWS slots, by the first), offset, words and size of each turn that takes words of a row."""
    sources = written(targets(sizes), "mix-sources")
    rows = written(streams(sizes, sources, ("seal", "row"), ("source", "run", "hash", "seal")), "mix-streams")
    turns = taken_parts(rows, sources).groupBy("row", "turn").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot")).join(rows, "row")
    stretch = F.floor(F.col("first_slot") / RUN_ROWS).cast("int").alias("stretch")
    return written(turns.select("source", "run", "hash", "doc_id", "seal", "turn", "first_slot", stretch, "offset", "words", "size"), "mix-turns")


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix has them: each row once per turn that takes words of it, with its own columns, in order of first slots.

    Whole texts stay as they are; of the last document that a target reaches only the words taken stay, one blank
    apart, and n_chars, where there is one, is the length of the new text. Rows without words are in no mix.

    docs is read twice, and has to give the same rows both times. No copy of it is kept, and texts are shuffled once, to where they stay: within a
    run of its source's stream, the rows whose first slots lie in one stretch of the schedule lie between two of them, so a
    small table of these tells where each row goes. There it meets its turns.
    """
    names = docs.columns
    seal = _seal(docs)
    sizes = written(sized(docs.select("doc_id", "source", "text", seal.alias("seal")), "seal").withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    turns = _turns(sizes)
    key = F.struct("hash", "doc_id", "seal")
    ranges = turns.groupBy("source", "run", "turn", "stretch").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ranges = written(ranges.groupBy("source", "run").agg(F.collect_list(F.struct("turn", "stretch", "low", "high")).alias("ranges")), "mix-ranges")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.col("source").cast("string").alias("_source"), _hash("doc_id").alias("hash"), "doc_id", seal.alias("seal"))
    rows = rows.withColumn("_run", F.pmod("hash", F.lit(_runs(sizes)))).withColumn("key", key)
    rows = rows.join(ranges, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_run") == F.col("run")))
    rows = rows.select("doc", "doc_id", "seal", F.explode(F.filter("ranges", lambda r: F.col("key").between(r["low"], r["high"]))).alias("range"))
    rows = rows.select("range.stretch", "range.turn", "doc_id", "seal", "doc")
    told = turns.select("stretch", "turn", "doc_id", "seal", F.struct("first_slot", "offset", "words", "size").alias("at"))
    stretches = (turns.agg(F.max("stretch")).first()[0] or 0) + 1
    both = rows.unionByName(told, allowMissingColumns=True).repartitionById(stretches, F.col("stretch"))
    # A stretch is a partition already, so a row meets its turns without another shuffle; rows that are the same are met by the turns of each.
    same = Window.partitionBy("stretch", "turn", "doc_id", "seal")
    met = F.coalesce(F.first("doc", ignorenulls=True).over(same), F.raise_error(F.lit("docs had other rows when it was read again")))
    out = both.withColumn("doc", met).where("at is not null").select("doc", "turn", "at.*")
    out = out.sortWithinPartitions("first_slot", "turn", "offset")
    text = F.when(F.col("words") == F.col("size"), F.col("doc.text")).otherwise(F.array_join(F.slice(word_array(F.col("doc.text")), 1, F.col("words").cast("int")), " "))
    new = {"text": text, "n_chars": F.when(F.col("words") == F.col("size"), F.col("doc.n_chars")).otherwise(F.length(text))} if "n_chars" in names else {"text": text}
    return out.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in names))
