"""Written dates in the JVM against the reader in Python, and composite values, through the whole way out and back."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from veilmill.operators import dates, detect, vault, written_dates
from veilmill.operators.canonical import canonical
from veilmill.operators.generate import Generator
from veilmill.plans.pseudonymise import pseudonymise, resolved_spans, restore

KEYS = vault.Keys(b"k" * 32)


def hands(day):
    d, m, y = day.day, day.month, f"{day.year:04d}"
    fr, en, short_fr, short_en = dates.MONTHS_FR[m - 1], dates.MONTHS_EN[m - 1], dates.SHORT_FR[m - 1].split()[0], dates.SHORT_EN[m - 1]
    return [f"{d} {fr} {y}", f"{d} {dates.plain(fr)} {y}", f"{d} {en.title()} {y}", f"{d} {en.upper()} {y}", f"{en.title()} {d}, {y}", f"{short_en.split()[0].title()} {d} {y}", f"{d} {short_fr} {y}", f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}", f"{y}/{m}/{d}", f"{y}/{m:02d}/{d:02d}"]


def test_dates_move_as_the_reader_moves_them(spark):
    rng = random.Random(1)
    texts = sorted({t for _ in range(80) for t in hands(datetime.date(rng.randint(1000, 9998), rng.randint(1, 12), rng.randint(2, 28)))})
    rows = spark.createDataFrame([(t, n) for t in texts for n in (0, 37, 400)], "t string, n int").withColumn("m", written_dates.moved(F.col("t"), F.col("n"))).collect()
    # The reader wants a comma between day and year; such dates without one must move here all the same.
    wanted = {(r["t"], r["n"]): dates.shift_text(r["t"], r["n"]) or dates.shift_text(re.sub(r"(\d) (\d)", r"\1, \2", r["t"]), r["n"]).replace(",", "") for r in rows}
    assert [(r["t"], r["n"], r["m"], wanted[r["t"], r["n"]]) for r in rows if r["m"] != wanted[r["t"], r["n"]]] == []


def test_what_is_no_date_is_left(spark):
    texts = ["31/31/2020", "30 February 2020", "soon", "", "2020-01-31", "3 Marchs 2020", "1/2.2020", "March 2020", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(written_dates.moved(F.col("t"), F.lit(3)).alias("m")).collect()
    assert [r["m"] for r in rows] == [None] * len(texts)


def test_dates_persons_and_addresses_go_by_default_and_come_back(spark):
    text = "Contact Mr. John Smith about it, at 12 rue de la Paix. On 3 March 2020, or le 1er avril 2021, 31/01/2020; not 2020-02-30. See 3 March 2020."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    safe, mapping = pseudonymise(docs, "s", KEYS)
    out = {r["doc_id"]: r["safe_text"] for r in safe.collect()}
    assert not re.search("John|Smith|Paix|3 March 2020|avril 2021|31/01/2020", out[1]) and out[2] == out[3] == ""
    assert re.search(r"On [0-9]{1,2} [A-Z][a-z]+ 20[0-9]{2}, or le [0-9]{1,2}(er)? \w+ 20", out[1])
    assert {r["restored"] for r in restore(safe, mapping, "s", KEYS).collect()} == {text, ""}


def test_blocks_of_any_length_are_found_whole(spark):
    block = "-----BEGIN PGP MESSAGE-----\n" + "abcdefgh\n" * 9_000 + "-----END PGP MESSAGE-----"
    lone = "-----BEGIN PGP SIGNED MESSAGE-----\nx\n-----BEGIN CERTIFICATE-----\ny\n-----END CERTIFICATE-----"
    rows = spark.createDataFrame([(1, f"a {block} b {lone} -----END PGP MESSAGE-----")], "doc_id long, text string").select(F.explode(detect.armour_spans("text")).alias("s")).select("s.*").collect()
    assert [(r["type"], len(r["value"]), r["start"]) for r in rows] == [("CRYPTOGRAPHIC_KEY", len(block), 2), ("CERTIFICATE", 55, 2 + len(block) + 3 + 37)]


@pytest.mark.parametrize(
    ("kind", "value", "shape"),
    [
        ("URL", "http://[2001:db8::5]:8080/a", r"http://\[2001:db8:[0-9a-f:]+\]:8080/x[0-9a-f]{8}"), ("URL", "mailto:jane.doe@corp-real.com", r"mailto:[a-z]+\.[a-z]+@[a-z-]+\.[a-z]+"),
        ("URL", "https://h.corp-real.com/p;y=1/q?a.b@c=1&page=2", r"https://[a-z0-9.-]+/x[0-9a-f]{8};y=x[0-9a-f]{8}/x[0-9a-f]{8}\?x[0-9a-f]{8}=x[0-9a-f]{8}&page=x[0-9a-f]{8}"),
        ("HASH", "sha256:" + "ab" * 32, r"sha256:[0-9a-f]{64}"), ("HASH", "ab" * 100, r"[0-9a-f]{200}"), ("DATE", "3 March 2020", r"[0-9]{1,2} [A-Z][a-z]+ 20[0-9]{2}"),
        ("CONTAINER_IMAGE", "r.corp-real.com/" + "/".join("abcdefgh"[i % 8] * 4 for i in range(120)) + ":1", r"[^/]+(/[^/]+){120}:1"),
    ],
)
def test_composite_values_keep_their_shape(spark, kind, value, shape):
    row = spark.createDataFrame([(kind, value)], "k string, v string").withColumn("c", canonical(F.col("k"), F.col("v")))
    got = row.select(Generator(b"s" * 32).candidate(F.col("k"), F.col("v"), F.col("c"), F.lit(0)).alias("x")).first()["x"]
    assert re.fullmatch(shape, got), got
    assert not re.search("corp-real|jane|doe|a\\.b@c|2001:db8::5", got)


def test_composites_are_restored(spark):
    text = "See http://[2001:db8::5]:8080/a and https://db1.corp-real.com/p;y=1?a.b@c=1 please."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    safe, mapping = pseudonymise(docs, "s", KEYS)
    out = safe.first()["safe_text"]
    assert "corp-real" not in out and "2001:db8::5" not in out
    assert restore(safe, mapping, "s", KEYS).first()["restored"] == text
    assert resolved_spans(docs).first()["spans"]
