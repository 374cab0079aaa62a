"""mixed(): texts move once, no copy of them is kept, and rows come in the schedule's order over many stretches of it."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilmill.llm import common, mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    return common.written(spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS).repartition(3), "test")


def test_texts_move_once_and_no_copy_is_written(spark, monkeypatch):
    docs = table(spark, [(i, f"word{i} " * (i % 90), "en", f"s{i % 3}") for i in range(400)])
    kept = []
    monkeypatch.setattr(mixing, "RUN_ROWS", 8)
    monkeypatch.setattr(mixing, "written", lambda df, label: kept.append(df.schema.simpleString()) or common.written(df, label))
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert kept and not any(re.search(r"\b(text|doc):", columns) for columns in kept)
    assert re.findall(r"(?<!Broadcast)Exchange (\w+)", plan) == ["shufflepartitionidpassthrough"]


@pytest.mark.parametrize("slots", [2, 7, 16_384])
def test_rows_come_in_the_order_of_the_schedule(spark, monkeypatch, slots):
    monkeypatch.setattr(mixing, "RUN_ROWS", slots)
    docs = table(spark, [(i, None if i % 31 == 5 else f"w{i} " * (i * 37 % 700), "en", None if i % 4 == 3 else f"s{i % 4}") for i in range(150)])
    starts = {}
    for slot, i, turn, at, _ in mixing.blocks(docs).collect():
        starts.setdefault((i, turn), len(starts))
    got = mixing.mixed(docs)
    assert (got.rdd.getNumPartitions() > 3) == (slots < 100)
    assert [r["doc_id"] for r in got.collect()] == [i for i, _ in sorted(starts, key=starts.get)]


@pytest.mark.parametrize("slots", [1, 3, 16_384])
def test_rows_that_repeat_are_mixed_one_by_one(spark, monkeypatch, slots):
    """Rows alike, rows of one id with other texts or columns, and null ids: each comes as often as its turns take words of it."""
    monkeypatch.setattr(mixing, "RUN_ROWS", slots)
    rows = [(7, "a b c " * 90, "en", "x")] * 5 + [(7, "a b d " * 90, "en", "x"), (7, "a b c " * 90, None, "x"), (7, "a b c " * 90, "en", None)]
    rows += [(None, "n u l l " * 60, "fr", "y")] * 3 + [(None, "other words", "fr", "y"), (None, None, "fr", "y"), (8, "", None, None)]
    docs = table(spark, rows + [(i, f"v{i} " * (40 + i), "en", "xyz"[i % 3]) for i in range(20, 60)])
    got = mixing.mixed(docs).collect()
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(re.findall(WORD, r["text"])) for r in got) == taken
    held = Counter(map(tuple, docs.collect()))
    count = Counter(map(tuple, got))
    # Of each source at most one row is cut; all others are whole, at most twice for each time that docs has them.
    assert sum(n for r, n in count.items() if r not in held) <= 4 and all(n <= 2 * held[r] for r, n in count.items() if r in held)
    assert sum(min(1, n) for r, n in count.items() if r in held) > 35
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed(docs).collect()))
