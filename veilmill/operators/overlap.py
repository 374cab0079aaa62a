"""Overlap arbitration: spans of a text become disjoint, and a loser keeps what no winner covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CLASS_OF, DEFAULT_CLASS, DEFAULT_PRIORITY, PRIORITY_OF


def class_of(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CLASS_OF.items() for x in pair))
    return F.coalesce(F.element_at(table, kind), F.lit(DEFAULT_CLASS))


def priority_of(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PRIORITY_OF.items() for x in pair))
    return F.coalesce(F.element_at(table, kind), F.lit(DEFAULT_PRIORITY))


def ranked(spans: Column) -> Column:
    """Spans in the order in which they win: secrets, then all but public ones, long before short, then by priority, score, type and start."""
    return F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                (class_of(s["type"]) != "secret").alias("late"), (class_of(s["type"]) == "public").alias("last"), (s["start"] - s["end"]).alias("short"),
                priority_of(s["type"]).alias("priority"), (-s["score"]).alias("unsure"), s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"),
            ),
        )
    )


def resolved(spans: Column, text: str) -> Column:
    """array<struct<start, end, type, score, value>>, ascending and disjoint: each span, winners first, gives its uncovered pieces.

    Spans are parted into islands that overlap, and each island is settled by itself: a long text with many spans costs
    no more than its islands do.
    """
    piece = "struct<start:int,end:int>"
    kept = "array<struct<start:int,end:int,type:string,score:double>>"

    def place(state: Column, s: Column) -> Column:
        def cut(pieces: Column, k: Column) -> Column:
            parts = F.transform(
                pieces,
                lambda p: F.when((k["end"] <= p["start"]) | (k["start"] >= p["end"]), F.array(p)).otherwise(
                    F.filter(F.array(F.struct(p["start"].alias("start"), F.least(p["end"], k["start"]).alias("end")), F.struct(F.greatest(p["start"], k["end"]).alias("start"), p["end"].alias("end"))), lambda x: x["start"] < x["end"])
                ),
            )
            return F.flatten(parts)

        whole = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(f"array<{piece}>")
        free = F.aggregate(state, whole, cut)
        return F.concat(state, F.transform(free, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), s["type"].alias("type"), s["score"].alias("score"))))

    simple = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["score"].alias("score"))))
    start = F.struct(F.array().cast(f"array<{kept}>").alias("islands"), F.array().cast(kept).alias("now"), F.lit(-1).alias("until"))

    def gather(s: Column, x: Column) -> Column:
        inside = x["start"] < s["until"]
        return F.struct(
            F.when(inside | (F.size(s["now"]) == 0), s["islands"]).otherwise(F.concat(s["islands"], F.array(s["now"]))).alias("islands"),
            F.when(inside, F.concat(s["now"], F.array(x))).otherwise(F.array(x)).alias("now"),
            F.greatest(s["until"], x["end"]).alias("until"),
        )

    islands = F.aggregate(simple, start, gather, lambda s: F.concat(s["islands"], F.array(s["now"])))
    settled = F.transform(islands, lambda i: F.when(F.size(i) <= 1, i).otherwise(F.array_sort(F.aggregate(ranked(i), F.array().cast(kept), place))))
    out = F.flatten(settled)
    return F.transform(out, lambda p: p.withField("value", F.substring(F.col(text), p["start"] + 1, p["end"] - p["start"])))


def overlap_pairs(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of spans of one text that overlap, each once: an equi-join on the text with the interval test as its condition."""
    a = spans.select(key, F.col("type").alias("type_a"), F.col("start").alias("start_a"), F.col("end").alias("end_a"))
    b = spans.select(key, F.col("type").alias("type_b"), F.col("start").alias("start_b"), F.col("end").alias("end_b"))
    return a.join(b, key).where("start_a < end_b and start_b < end_a and (start_a, end_a, type_a) < (start_b, end_b, type_b)")


def contained(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that a longer span of the text contains."""
    longer = spans.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    return spans.join(longer, (F.col(key) == F.col("k")) & F.expr("s <= start and e >= end and e - s > end - start"), "left_semi")


def uncovered(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that overlap no other span of the text."""
    other = spans.select(F.col(key).alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("type").alias("t"))
    return spans.join(other, (F.col(key) == F.col("k")) & F.expr("s < end and start < e and not (s = start and e = end and t = type)"), "left_anti")
