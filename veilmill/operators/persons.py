"""Persons whom a corpus confirms once and names bare elsewhere.

Rules find a name where a title or a label marks it (detect.PERSONAL). Here the names found so become a gazetteer, a table, and runs of
capitalised words of the whole corpus meet it:

* a name of several words is found wherever it stands;
* so is a pair that no title confirms, if its first word is the first of some confirmed name and its last word the last of one;
* a single word is found if it ends a confirmed name.

Words that count for the latter two must be proper names in this corpus: PROPER of 100 of all their occurrences, in any case of
letters, start with a capital. So "Mr. Brown" does not make every "Brown" at the head of a sentence a person.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findall import each, find_all
from ..session import materialise
from .inventory import met, uncovered

#: A word's characters; a run of them is one word. Particles stand between the words of a name.
CHARS, PARTICLES = r"[\p{L}\p{N}'’-]", "(?:de |van |von |la |le |du )"
NAME_WORD = r"\p{Lu}[\p{L}'’-]{1,30}"
#: A capitalised word with what links it to the next one.
PIECE = rf"(?=\p{{Lu}})(?<!{CHARS}){NAME_WORD}(?!{CHARS})(?: {PARTICLES}?)?"
#: Names have at most so many capitalised words, as those that the rules find.
LONGEST = 4
#: Of 100 occurrences of a proper name, as many start with a capital.
PROPER = 90
SCORE = 0.7
WINDOW = "struct<value:string,first:string,last:string,k:int,start:int>"


def windows(text: str) -> Column:
    """array of (value, first, last, k, start): each run of 1 to LONGEST capitalised words that blanks or particles part."""
    piece = find_all(text, PIECE, "PERSON", SCORE)

    def word(p: Column) -> Column:
        return F.substring_index(p["value"], " ", 1)

    def linked(a: Column, b: Column) -> Column:
        return F.endswith(a["value"], F.lit(" ")) & (a["end"] == b["start"])

    def window(*parts: Column) -> Column:
        value = F.concat(*(x["value"] for x in parts[:-1]), word(parts[-1]))
        return F.struct(value.alias("value"), word(parts[0]).alias("first"), word(parts[-1]).alias("last"), F.lit(len(parts)).alias("k"), parts[0]["start"].alias("start"))

    def of(p: Column, starts: Column, k: int) -> Column:
        def at(i: Column) -> Column:
            parts = [F.get(p, i + j) for j in range(k)]
            return F.when(reduce(and_, (linked(a, b) for a, b in zip(parts[1:], parts[2:], strict=False)), F.lit(True)), window(*parts))

        # Beyond the end of p, no part has an end: the condition is null and there is no window.
        return F.filter(F.transform(starts, at), lambda w: w.isNotNull())

    def every(p: Column) -> Column:
        # Few words have one linked to them, so runs of several start from those that do.
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 2), lambda i: linked(F.get(p, i), F.get(p, i + 1)))
        starts = F.when(F.size(p) > 1, starts).otherwise(F.array().cast("array<int>"))
        longer = F.get(F.transform(F.array(starts), lambda s: F.when(F.size(s) > 0, F.concat(*(of(p, s, k) for k in range(2, LONGEST + 1)))).otherwise(F.array().cast(f"array<{WINDOW}>"))), F.lit(0))
        return F.concat(F.transform(p, lambda x: window(x)), longer)

    return F.get(F.transform(F.array(piece), every), F.lit(0))


def confirmed(spans: DataFrame) -> DataFrame:
    """name, first, last, k of the distinct names among spans (type, value) of persons, k words without particles."""
    words = F.filter(F.split("value", " +"), lambda w: w.rlike(rf"\A{NAME_WORD}\z"))
    rows = spans.where("type = 'PERSON'").select("value").distinct().select(F.col("value").alias("name"), words.alias("w")).where("size(w) > 0")
    return rows.select("name", F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last"), F.size("w").alias("k"))


def proper_words(docs: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """The words (word) that start with a capital in PROPER of 100 of their occurrences in the texts."""
    all_words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(f"{CHARS}+"), F.lit(0))).alias("w"))
    # Counted by spelling first, so that few rows are shuffled.
    spelt = all_words.groupBy("w").agg(F.count("*").alias("n")).withColumn("_low", F.lower("w"))
    asked = words.select("word").distinct().withColumn("_low", F.lower("word"))
    seen = asked.join(spelt, "_low").groupBy("word").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("w").rlike(r"\A\p{Lu}"), F.col("n"))).alias("n_capital"))
    return seen.where(F.col("n_capital") * 100 >= F.col("n_all") * PROPER).select("word")


def accepted(docs: DataFrame, occurrences: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """value, n: the distinct runs of capitalised words that names confirm, with their occurrences."""
    names = materialise(names, "names")
    runs = materialise(occurrences.groupBy("value", "first", "last", "k").agg(F.count("*").alias("n")), "runs")
    ends = names.where("k > 1").select(F.lit("first").alias("place"), F.col("first").alias("word")).union(names.select(F.lit("last"), "last")).distinct()
    proper = proper_words(docs, ends, text)
    ends = materialise(ends.join(proper, "word"), "ends")
    firsts, lasts = (ends.where(F.col("place") == p).select(F.col("word").alias(p)) for p in ("first", "last"))
    whole = runs.where("k > 1").join(names.select(F.col("name").alias("value")).distinct(), "value", "left_semi")
    pairs = runs.where("k > 1").join(lasts, "last", "left_semi").join(firsts, "first", "left_semi")
    single = runs.where("k = 1").join(lasts, "last", "left_semi")
    return whole.select("value", "n").union(pairs.select("value", "n")).union(single.select("value", "n")).groupBy("value").agg(F.first("n").alias("n"))


def _merged(hits: DataFrame, row: str) -> DataFrame:
    """Overlapping spans of a row as one. Their values overlap as they do, so the whole value comes from them."""
    order = Window.partitionBy(row).orderBy("start", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.count_if(F.coalesce(F.col("start") >= F.col("_before"), F.lit(True))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    dealt = hits.withColumn("_before", before).withColumn("_island", island).where("_before is null or end > _before")
    parts = dealt.groupBy(row, "_island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("p"))
    start = F.struct(F.get("p", F.lit(0))["start"].alias("at"), F.lit("").alias("value"))
    # at is where the value so far ends.
    whole = F.aggregate("p", start, lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["value"], F.substring(x["value"], s["at"] - x["start"] + 1, F.length(x["value"]))).alias("value")), lambda s: s["value"])
    return parts.select(row, F.lit("PERSON").alias("type"), whole.alias("value"), F.get("p", F.lit(0))["start"].alias("start"), F.element_at("p", -1)["end"].alias("end"), F.lit(SCORE).alias("score"))


def marked(docs: DataFrame, taken: DataFrame, row: str = "_row", text: str = "text") -> DataFrame | None:
    """row, type, value, start, end, score of persons named bare, where none of the spans taken (row, type, value, start, end) lies; None
    where these confirm no person.

    row numbers the rows of docs, each once, and docs is a written table or one that gives the same numbers again. Null and empty
    texts name nobody. Runs are looked for once and written, some tenths of the texts' size. Distinct runs are counted first, with partial sums, and meet the gazetteer, which is a table; then occurrences meet what
    it confirms, hot ones salted. Texts are never shuffled.
    """
    names = confirmed(taken)
    if names.isEmpty():
        return None
    occurrences = materialise(each(docs.select(row, windows(text).alias("_windows")), "_windows", row), "windows")
    owned = materialise(accepted(docs, occurrences, names, text), "persons")
    hits = met(occurrences.select(row, "value", "start"), owned, row).select(row, F.lit("PERSON").alias("type"), "value", "start", (F.col("start") + F.length("value")).alias("end"), F.lit(SCORE).alias("score"))
    return _merged(uncovered(hits, taken, row), row)
