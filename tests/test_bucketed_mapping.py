import re

import pytest
from pyspark.sql import functions as F

from veilmill.operators import vault
from veilmill.plans import pseudonymise as plan

KEYS = vault.Keys(b"k")
TEXTS = ["mail a.b@corp.example from 10.1.2.3", "10.1.2.4 and db1.corp.example", "nothing"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def safe(out):
    return {r["doc_id"]: r["safe_text"] for r in out.collect()}


@pytest.fixture()
def store(spark, tmp_path):
    kept = vault.Bucketed(spark, "known_mapping", f"file://{tmp_path}/mapping", 4)
    yield kept
    for part in kept.PARTS:
        spark.sql(f"DROP TABLE known_mapping_{part}")


def test_a_second_run_allocates_what_is_new_only(spark, store):
    first, mapping = plan.pseudonymise(docs(spark, TEXTS), "s", KEYS, known=store.known())
    before, n = safe(first), mapping.count()
    store.append(mapping)
    again, mapping = plan.pseudonymise(docs(spark, [*TEXTS, "10.1.2.99 A.B@corp.example"]), "s", KEYS, known=store.known())
    after = safe(again)
    assert {k: after[k] for k in before} == before and all("10.1.2." not in t for t in after.values())
    # The address has a network that is known, the mail address is known.
    assert mapping.count() == n + 1 and before[0].split()[1].lower() == after[3].split()[1].lower()
    plain, _ = plan.pseudonymise(docs(spark, TEXTS), "s", KEYS, known=store.rows())
    assert safe(plain) == before
    other, _ = plan.pseudonymise(docs(spark, TEXTS), "t", KEYS, known=store.known())
    assert safe(other)[0] != before[0]


def test_what_a_dead_writer_left_out_is_mended(spark, store):
    mapping = vault.allocate(vault.entities(spark.createDataFrame([("IP_ADDRESS", "10.0.0.1")], "type string, value string")), "s", KEYS)
    store._add("by_surrogate", mapping)
    store._add("by_key", mapping)
    assert store.table("by_real").count() == 0
    store.mend()
    store.mend()
    assert store.table("by_real").count() == store.table("by_key").count() == mapping.count()


def test_the_known_side_is_not_shuffled(spark, store):
    store.append(vault.allocate(vault.entities(spark.createDataFrame([("IP_ADDRESS", "10.0.0.1")], "type string, value string")), "s", KEYS))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        known = store.known()
        asked = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("key_idx"))
        for column, side, how in (("key_idx", known.keyed("s"), "left_anti"), ("real_idx", known.real("s"), "left"), ("surrogate", known.taken("s"), "left_anti")):
            joined = asked.withColumnRenamed("key_idx", column).join(side, column, how)
            text = joined._jdf.queryExecution().executedPlan().toString()
            exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
            assert len(exchanges) == 1 and "SortMergeJoin" in text and "Bucketed: true" in text, text
            # The one exchange lies above the rows that ask.
            assert text.index("Exchange hashpartitioning") < text.index("Range (") < text.index("FileScan"), text
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_names_and_second_writers_are_refused(spark, store):
    with pytest.raises(ValueError):
        vault.Bucketed(spark, "x; drop", "file:///tmp/none")
    with vault.alone(spark, store.path), pytest.raises(RuntimeError):
        store.append(store.rows())
