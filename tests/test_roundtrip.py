from pyspark.sql import functions as F

from veilmill import catalogue
from veilmill.operators import vault
from veilmill.plans import pseudonymise as plan


def test_roundtrip_looks_for_spans_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(plan, "resolved_spans", lambda *a, f=plan.resolved_spans, **b: calls.append(1) or f(*a, **b))
    assert catalogue.QUERIES["restore_roundtrip"](spark, "/root/testdata/sf0.001").count() == 0
    assert len(calls) == 1


def test_equal_null_and_clean_texts_come_back_by_either_join(spark, monkeypatch):
    texts = ["mail a.b@mail1.example.com from 10.1.2.3", "mail a.b@mail1.example.com from 10.1.2.3", "nothing here", "nothing here", "", None, "10.1.2.3\n10.1.2.4 10.1.2.3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keys = vault.Keys(b"k")
    rows = plan.numbered(plan.resolved_spans(docs))
    safe, mapping = plan.pseudonymise(rows, "s", keys, searched=True)
    safe = safe.withColumn("safe_text", F.when(F.col("doc_id") != 5, F.col("safe_text")))
    assert {r["doc_id"] for r in safe.collect() if r["safe_text"] == texts[r["doc_id"]]} == {2, 3, 4, 5}
    for small in (plan.SMALL, 0):
        monkeypatch.setattr(plan, "SMALL", small)
        back = plan.restore(safe, mapping, "s", keys)
        assert back.columns == [*safe.columns, "restored"]
        assert sorted((r["doc_id"], r["restored"]) for r in back.collect()) == list(enumerate(texts))
