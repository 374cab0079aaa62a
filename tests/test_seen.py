import os
import time

import pytest
from pyspark.sql import functions as F

from veilmill.operators import detect, vault
from veilmill.plans import pseudonymise as plan
from veilmill.plans.seen import Seen, method_of, pseudonymise_seen

KEYS = vault.Keys(b"k")
TEXTS = [(1, "mail a@corp.example and b@corp.example"), (2, "mail a@corp.example and b@corp.example"), (1, "host db1.corp.internal"), (None, "nothing of note"), (3, None), (4, ""), (5, " .. "), (6, "𝄞 10.1.2.3 𝄞 c@d.org")]


@pytest.fixture()
def store(spark, tmp_path):
    name = "seen_" + os.path.basename(tmp_path).replace("-", "_")
    yield Seen(spark, name, f"file://{tmp_path}", KEYS, buckets=4)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def spans_by_text(df):
    return {r["text"]: [s.asDict() for s in r["spans"]] for r in df.collect()}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_second_run_searches_nothing(spark, store):
    docs = docs_of(spark, TEXTS)
    first, c1 = store.searched(docs)
    c1 = c1.first()
    assert (c1["calls"], c1["hits"], c1["searched"]) == (5, 0, 4)
    want = spans_by_text(plan.resolved_spans(docs).where(F.col("text").rlike(r"(?U)\w")))
    assert spans_by_text(first) == want
    again, c2 = store.searched(docs)
    c2 = c2.first()
    assert (c2["calls"], c2["hits"], c2["searched"], c2["n_spans"]) == (5, 5, 0, c1["n_spans"])
    assert spans_by_text(again) == want
    assert store.table().count() == 4


def test_only_new_texts_are_searched_and_other_recognisers_search_again(spark, store):
    store.searched(docs_of(spark, TEXTS[:3]))
    c = store.searched(docs_of(spark, TEXTS))[1].first()
    assert (c["calls"], c["hits"], c["searched"]) == (5, 3, 2)
    other = Seen(spark, store.name, store.path, KEYS, detect.RECOGNISERS, buckets=4)
    assert other.method == method_of(detect.RECOGNISERS) != store.method
    c = other.searched(docs_of(spark, TEXTS))[1].first()
    assert (c["hits"], c["searched"]) == (0, 4)
    assert {r["method"] for r in store.forget().select("method").distinct().collect()} == {store.method}
    assert Seen(spark, store.name, store.path, KEYS, rules="2", buckets=4).method != store.method


def test_empty_table(spark, store):
    rows, counters = store.searched(docs_of(spark, []))
    assert rows.count() == 0 and counters.first().asDict() == {"calls": 0, "hits": 0, "searched": 0, "n_spans": 0}


def test_nothing_real_is_stored(spark, store):
    store.searched(docs_of(spark, TEXTS))
    held = " ".join(str(r) for r in store.table().collect())
    assert "corp" not in held and "10.1.2.3" not in held
    import hashlib

    assert hashlib.sha256(TEXTS[0][1].encode()).hexdigest() not in held


def test_known_side_is_not_shuffled(spark, store):
    store.searched(docs_of(spark, TEXTS))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = store.looked_up(docs_of(spark, TEXTS))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, line in enumerate(lines) if store.name in line and "Scan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    level, above = depth(lines[at]), []
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above)


def test_pseudonymised_once_and_restored(spark, store):
    docs = docs_of(spark, TEXTS)
    plain_rows, plain_mapping = plan.pseudonymise(docs, "s", KEYS)
    key = lambda r: (str(r["doc_id"]), r["n_spans"], r["n_entities"], r["safe_text"])
    want = sorted(map(key, plain_rows.collect()))
    for hits in (0, 5):
        safe, mapping, counters = pseudonymise_seen(docs, store, "s", KEYS)
        assert sorted(map(key, safe.collect())) == want and counters.first()["hits"] == hits
        back = plan.restore(safe, mapping, "s", KEYS).select("restored").collect()
        assert sorted(r["restored"] for r in back) == sorted(t or "" for _, t in TEXTS)


def test_a_dead_writers_lock_is_taken_over_once(spark, tmp_path):
    path = f"file://{tmp_path}"
    (tmp_path / "_lock").touch()
    with pytest.raises(RuntimeError), vault.alone(spark, path):
        pass
    old = time.time() - 3600
    os.utime(tmp_path / "_lock", (old, old))
    with vault.alone(spark, path, beat=0.1):
        with pytest.raises(RuntimeError), vault.alone(spark, path):
            pass
        os.utime(tmp_path / "_lock", (old, old))
        time.sleep(0.5)
        assert time.time() - os.path.getmtime(tmp_path / "_lock") < 60
    assert not (tmp_path / "_lock").exists()
    with vault.alone(spark, path):
        pass
    # Two that saw the same dead lock: the marker lets one in only.
    (tmp_path / "_lock").touch()
    os.utime(tmp_path / "_lock", (old, old))
    (tmp_path / f"_lock-taken-{int(os.stat(tmp_path / '_lock').st_mtime * 1000)}").touch()
    with pytest.raises(RuntimeError), vault.alone(spark, path):
        pass
