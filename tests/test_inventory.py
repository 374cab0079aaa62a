import re

import pytest
from pyspark.sql import functions as F

from veilmill.functions.findall import CHUNK, find_all
from veilmill.operators import inventory, vault
from veilmill.plans import pseudonymise as plan

SPANS = "array<struct<type:string,value:string,start:int,end:int,score:double>>"


def expected(text, labels, spans=()):
    """Brute force: each token, each run of its segments."""
    want = {tuple(p for p in re.split(r"[.:/@+_-]+", label.lower()) if p) for label in labels if label} - {()}
    out = []
    for m in re.finditer(r"[\w.:/@+-]+", text or ""):
        p = [x for x in re.split(r"[.:/@+_-]+", m.group().lower()) if x]
        runs = {tuple(p[i:j]) for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        if runs & want and not any(a < m.end() and m.start() < b for a, b in spans):
            out.append((m.start(), m.end(), m.group()))
    return out


LABELS = ["acme", "DB.Prod.Example", None, "", "...", "straße", "база"]
TEXTS = [
    "kubectl -n acme-billing", "acmecorp is not ours, AcMe is", "x.db.prod.example:80/a and db.prod and prod.example", None, "", "  ",
    "Straße/12 база_1 базар", "acme " * 3000, "acme." * 60, "a@acme.io acme", "a@acme.io acme",
]


def marked(spark, texts, labels, spans=None):
    rows = [(i, t, [("X", t[a:b], a, b, 1.0) for a, b in (spans or {}).get(i, [])] if t else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"_row bigint, text string, spans {SPANS}")
    table = spark.createDataFrame([(x,) for x in labels], "label string")
    found = {}
    for r in inventory.marked(docs, table, spans="spans").collect():
        assert (r["type"], r["score"]) == ("INVENTORY", 1.0)
        found.setdefault(r["_row"], []).append((r["start"], r["end"], r["value"]))
    return {k: sorted(v) for k, v in found.items()}


def test_against_brute_force(spark):
    spans = {9: [(0, 9)], 7: [(3, 7), (1000, 2600)], 10: []}
    got = marked(spark, TEXTS, LABELS, spans)
    want = {i: expected(t, LABELS, spans.get(i, ())) for i, t in enumerate(TEXTS)}
    assert got == {i: w for i, w in want.items() if w}
    assert len(got[10]) == 2 and len(got[9]) == 1


def test_empty_tables(spark):
    assert marked(spark, TEXTS, []) == {} and marked(spark, TEXTS, [None, "-"]) == {} and marked(spark, [], ["acme"]) == {}


def test_labels_reach_no_plan_and_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "a secretlabel b")], "_row bigint, text string")
    out = inventory.marked(docs, spark.createDataFrame([("secretlabel",)], "label string"))
    text = out._jdf.queryExecution().toString()
    assert "secretlabel" not in text and "CartesianProduct" not in text
    assert all("text" not in line for line in text.split("== Physical Plan ==")[1].splitlines() if "Exchange" in line)


def test_hot_tokens_are_dealt_to_many_keys(spark):
    n = 5000
    docs = spark.range(n).select(F.col("id").alias("_row"), F.lit("acme runs on acme").alias("text"))
    assert inventory.marked(docs, spark.createDataFrame([("acme",)], "label string")).count() == 2 * n


def test_inventory_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "pods of acme-billing by j.doe@acme.example"), (1, "acme"), (None, "nothing"), (2, None)], "doc_id bigint, text string")
    keys = vault.Keys(b"k")
    labels = spark.createDataFrame([("acme",)], "label string")
    safe, mapping = plan.pseudonymise(docs, "s", keys, inventory=labels)
    out = {r["safe_text"]: (r["n_spans"], r["n_entities"]) for r in safe.collect()}
    assert all("acme" not in t for t in out) and out["nothing"] == (0, 0) and sorted(out.values()) == [(0, 0), (0, 0), (1, 1), (2, 2)]
    back = plan.restore(safe, mapping, "s", keys).select("restored").collect()
    assert sorted(r["restored"] for r in back) == sorted(["pods of acme-billing by j.doe@acme.example", "acme", "nothing", ""])


@pytest.mark.parametrize("n", [0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 2 * CHUNK, 2 * CHUNK + 1, 20000])
def test_find_all_in_chunks(spark, n):
    text = "é" + "ab 𝄞 " * n + "x"
    got = spark.createDataFrame([(text,)], "text string").select(find_all("text", "ab", "X", 1.0).alias("s")).first()["s"]
    assert [(s["start"], s["end"], s["value"]) for s in got] == [(m.start(), m.end(), "ab") for m in re.finditer("ab", text)]
