import uuid

import pytest
from pyspark.sql import functions as F

from veilmill.streaming.restore import Restorer, restored_stream

VIEW = {"amber-cedar.internal": "db1.acme.internal", "amber-cedar": "web"}


@pytest.mark.parametrize("cut", range(0, 45, 3))
def test_every_cut_gives_the_same_text(cut):
    text = "see amber-cedar.internal, amber-cedars and amber-cedar"
    r = Restorer(VIEW)
    a, held = r.feed("", text[:cut])
    b, held = r.feed(held, text[cut:])
    assert r.whole(a) + r.whole(b) + r.whole(held) == r.whole(text) == "see db1.acme.internal, amber-cedars and web"


def test_stream_equals_batch(spark, tmp_path):
    text = "ask amber-cedar.internal or amber-cedar now"
    rows = [("s", 0, i, "text", c) for i, c in enumerate(text)] + [("s", 0, len(text), "stop", "")]
    rows += [("s", 1, 0, "json", '{"h": "amber'), ("s", 1, 1, "json", '-cedar"}'), ("s", 1, 2, "stop", ""), ("s", 2, 0, "json", "{bad"), ("s", 2, 1, "stop", ""), ("s", 3, 0, "opaque", "amber-cedar")]
    schema = "stream_id string, block int, seq bigint, kind string, text string"
    df = spark.createDataFrame(rows, schema)
    for i in range(3):
        df.where((F.col("seq") * 7 + F.col("block")) % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = "t" + uuid.uuid4().hex
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = restored_stream(source, VIEW).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql(f"SELECT * FROM {name}").collect()
    whole = lambda b: "".join(r["text"] for r in sorted((r for r in got if r["block"] == b), key=lambda r: r["seq"]))
    assert whole(0) == "ask db1.acme.internal or web now" and whole(1) == '{"h":"web"}' and whole(2) == "{bad" and whole(3) == "amber-cedar"
    assert [r["error"] for r in got if r["block"] == 2] == ["invalid json"]
