"""What is ours, by a table of labels of any size: tokens of texts whose segments hold a label become spans.

A label is one segment or several (`acme`, `db.acme.example`); it is met where its segments follow one another within a token, in any
case of letters. Labels are a table that tokens join by equality: none of them enters a plan, and a million cost no more than a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findall import each, find_all
from ..session import materialise

#: Tokens, and what parts their segments. Letters and digits of all scripts, in the terms that Java and RE2 share.
TOKEN, BREAK = r"[\p{L}\p{N}_.:/@+-]+", r"[.:/@+_-]+"
#: A token with more than one in HOT_SHARE of all occurrences of ours is hot: there are fewer than HOT_SHARE such; each is dealt to SALTS.
HOT_SHARE, SALTS = 1024, 64
#: Overlaps are looked for within cells of this many code points.
CELL = 256


def segments(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), BREAK), lambda s: s != "")


def label_table(labels: DataFrame, label: str = "label") -> DataFrame:
    """gram (segments with one blank between), size of the distinct labels; labels null or without a segment are none."""
    parts = labels.select(segments(F.col(label)).alias("p")).where("size(p) > 0")
    return parts.select(F.array_join("p", " ").alias("gram"), F.size("p").alias("size")).distinct()


def _grams(value: Column, sizes: list[int]) -> Column:
    """The distinct runs of segments as long as labels are."""

    def of(p: Column, n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(p) - n + 1), lambda i: F.array_join(F.slice(p, i, n), " "))
        return F.when(F.size(p) >= n, found).otherwise(F.array().cast("array<string>"))

    def runs(p: Column) -> Column:
        return F.array_distinct(F.concat(*(of(p, n) for n in sizes)))

    return F.get(F.transform(F.array(segments(value)), runs), F.lit(0))


def _occurrences(docs: DataFrame, row: str, text: str) -> DataFrame:
    """row, value, start of every token, start in code points from 0: gaps and tokens alternate, and their lengths add up."""
    found = find_all(text, TOKEN, "INVENTORY", 1.0)
    return each(docs.withColumn("_found", found), "_found", row).select(row, "value", "start")


def owned_tokens(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """value, n: the distinct tokens of the texts that hold a label, with their occurrences."""
    table = label_table(labels)
    # As many numbers as labels have different sizes.
    sizes = sorted(r["size"] for r in table.select("size").distinct().collect())
    if not sizes:
        return docs.sparkSession.createDataFrame([], "value string, n bigint")
    counted = docs.select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    met = counted.withColumn("gram", F.explode(_grams(F.col("value"), sizes))).join(table.select("gram"), "gram")
    return met.groupBy("value").agg(F.first("n").alias("n"))


def _cells(df: DataFrame) -> DataFrame:
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))


def marked(docs: DataFrame, labels: DataFrame, row: str = "_row", text: str = "text", spans: str | None = None) -> DataFrame:
    """row, type, value, start, end, score of INVENTORY spans: tokens that hold a label, where none of the row's own spans lies.

    row numbers the rows of docs, each once, and docs is a written table or one that gives the same numbers again; other ids may be null or
    repeat. Null and empty texts have no tokens, an empty table of labels marks nothing, and blank labels are none. Distinct tokens
    are counted first, with partial sums, and meet the labels; then occurrences meet the tokens that are ours. Hot tokens are
    dealt by row and place to SALTS keys, so no task gets all of them. Overlaps are joined by row and cell, in time that
    grows with spans and tokens, not with their product, and a long text is settled by many tasks. Texts are never shuffled.
    """
    owned = materialise(owned_tokens(docs, labels, text), "owned")
    ours = met(_occurrences(docs, row, text), owned, row).select(row, F.lit("INVENTORY").alias("type"), "value", "start", (F.col("start") + F.length("value")).alias("end"), F.lit(1.0).alias("score"))
    return ours if spans is None else uncovered(ours, docs.select(row, F.explode(spans).alias("s")).select(row, "s.start", "s.end"), row)


def met(occurrences: DataFrame, owned: DataFrame, row: str) -> DataFrame:
    """The occurrences (row, value, start) whose value is in owned (a written table value, n; n occurrences each). Hot values are dealt to SALTS keys."""
    total = owned.agg(F.sum("n").alias("total"))
    hot = owned.crossJoin(F.broadcast(total)).where(F.col("n") * HOT_SHARE > F.col("total")).select(F.xxhash64("value").alias("_h"), F.lit(True).alias("_hot")).distinct()
    salted = owned.select("value", F.xxhash64("value").alias("_h")).join(F.broadcast(hot), "_h", "left")
    salted = salted.select("value", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    placed = occurrences.withColumn("_h", F.xxhash64("value")).join(F.broadcast(hot), "_h", "left")
    placed = placed.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(row, "start"), F.lit(SALTS)).cast("int")).otherwise(0))
    return placed.join(salted, ["value", "_salt"]).select(row, "value", "start")


def uncovered(ours: DataFrame, taken: DataFrame, row: str) -> DataFrame:
    """The spans of ours that none of taken (row, start, end) overlaps."""
    ours = materialise(ours, "ours")
    taken = _cells(taken.select(row, "start", "end")).select(row, "_cell", F.col("start").alias("_a"), F.col("end").alias("_b"))
    covered = _cells(ours).join(taken, [row, "_cell"]).where("_a < end and start < _b").select(row, "start", "end").distinct()
    return ours.join(covered, [row, "start", "end"], "left_anti").select(row, "type", "value", "start", "end", "score")
