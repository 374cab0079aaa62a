"""Bodies, dates in texts, shared attributes, models, policies, stored mappings and reports."""

import base64
import datetime
import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from veilmill.operators import canonical as can
from veilmill.operators import dates, detect, policy, reports, rules, vault, walk
from veilmill.operators.generate import Generator
from veilmill.operators.overlap import resolved
from veilmill.plans import bodies
from veilmill.sources import readers
from veilmill.streaming import restore

KEYS = vault.Keys(b"test master")
SPANS = "array<struct<type:string,value:string,start:int,end:int,score:double>>"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first()["r"]


# Walks


def leaves(node):
    return {x["path"]: x["text"] for x in walk.leaves(json.dumps(node))}


def test_protocol_is_kept_by_place_and_shape_only():
    got = leaves(
        {
            "model": "m-1", "stream": True,
            "messages": [
                {"role": "user", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "toolu_01abcdefgh", "name": "read", "input": {"id": "db1.acme.internal", "model": "x"}}]},
                {"role": "jane.doe", "content": "x"}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "jane@corp.com", "content": "out"}]},
            ],
            "tools": [{"name": "read", "description": "d", "input_schema": {"type": "object", "properties": {"path": {"type": "string", "description": "a path", "enum": ["a", "b"], "$ref": "#/$defs/x"}, "e": {"enum": ["db1.acme.internal"], "default": "v"}}, "required": ["path"]}}],
        }
    )
    assert got == {
        "/messages/0/content/0/text": "hi", "/messages/0/content/1/input/id": "db1.acme.internal", "/messages/0/content/1/input#id": "id", "/messages/0/content/1/input/model": "x", "/messages/0/content/1/input#model": "model",
        "/messages/1/role": "jane.doe", "/messages/1/content": "x", "/messages/2/content/0/tool_use_id": "jane@corp.com", "/messages/2/content/0/content": "out",
        "/tools/0/description": "d", "/tools/0/input_schema/properties/path/description": "a path", "/tools/0/input_schema/properties/e/enum/0": "db1.acme.internal", "/tools/0/input_schema/properties/e/default": "v",
    }
    assert leaves({"model": "jane doe at corp"}) == {"/model": "jane doe at corp"}


def test_json_rpc_keeps_its_envelope():
    assert leaves([{"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "read", "arguments": {"k": "v"}}}]) == {"/0/params/arguments/k": "v", "/0/params/arguments#k": "k"}
    assert leaves({"jsonrpc": "2.0", "id": "jane", "error": {"code": 1, "message": "m"}}) == {"/id": "jane", "/error/message": "m"}
    assert leaves({"jsonrpc": "2.0", "method": "not a method!", "params": {"name": "x"}})["/method"] == "not a method!"


def test_base64_is_read_and_written_as_it_was():
    for encoding in ("utf-8", "utf-16-le", "cp1252"):
        text = "écrire à jane.doe at corp now, merci bien"
        raw = base64.b64encode(text.encode(encoding)).decode()
        read, encode = walk.encoded_text(raw)
        assert read == text and encode(text) == raw and walk.encoded_text(encode("autre texte à lire maintenant"))[0] == "autre texte à lire maintenant"
    assert walk.encoded_text(base64.b64encode(bytes(range(256))).decode()) is None and walk.encoded_text("plain words here and there") is None
    whole = base64.b64encode(b"mail jane.doe@corp.com please now").decode()
    assert any("jane.doe@corp.com" in r for r in walk.readings("x! " + whole[:30] + "\n" + whole[30:]))
    assert any("jane.doe@corp" in r for r in walk.readings("zz" + whole))
    began = time.time()
    walk.readings("word " * 200_000)
    walk.readings("ab-" * 100_000)
    assert time.time() - began < 5


def test_bodies_go_out_and_come_back(spark):
    inner = base64.b64encode(b"reach jane.doe@corp-real.com for more of this").decode()
    rows = [
        (1, json.dumps({"model": "m", "messages": [{"role": "user", "content": "ask jane.doe@corp-real.com on db1.acme.internal"}], "metadata": {"jane.doe@corp-real.com": "x"}, "blob": inner})),
        (None, json.dumps({"messages": [{"role": "user", "content": "jane.doe@corp-real.com"}]})), (2, "no json but jane.doe@corp-real.com"), (3, None), (4, "[]"),
    ]
    df = spark.createDataFrame(rows, "body_id bigint, body string")
    safe, mapping = bodies.pseudonymised(df, "s", KEYS)
    out = [r["body"] for r in safe.collect()]
    assert len(out) == 5 and not any("corp-real" in b or "acme" in b for b in out if b) and inner not in str(out)
    back = bodies.restored(safe, mapping, "s", KEYS)
    got = {r["body_id"]: (r["body"], r["unresolved"]) for r in back.collect()}
    for i, b in rows:
        assert (json.loads(got[i][0]) == json.loads(b)) if i != 2 and b else got[i][0] == b
    assert got[2][1] == 1 and bodies.unresolved(back).first()["unresolved"] == 1
    with pytest.raises(Exception, match="no JSON"):
        bodies.restored(safe, mapping, "s", KEYS, strict=True).collect()
    assert [json.loads(r["body"])["system"] for r in bodies.announced(df.where("body_id = 1"), "note").collect()] == ["note"]
    assert one(spark, bodies.searchable(F.col("t")), t=r"a\u0062c\/d e%41 ﬁ") == "abc/d e%41 fi\nabc/d eA fi"
    assert walk.payload_text({"a": ["b", {"c": 1}]}) == "a\nb\nc\n1"


# Dates


@pytest.mark.parametrize(
    ("text", "days", "moved"),
    [
        ("12 mars 2019", 240, "7 novembre 2019"), ("12 janv. 2019", 60, "13 mars 2019"), ("12 fevrier 2019", 180, "11 aout 2019"), ("3 fév. 2020", 30, "4 mars 2020"), ("15 Sept 2020", 30, "15 Oct 2020"), ("sept 15, 2020", 30, "oct 15, 2020"),
        ("2026-08", 40, "2026-09"), ("Q3 2024", 100, "Q4 2024"), ("t3 2024", 100, "t4 2024"), ("Feb 28", 2, "Mar 1"), ("28 février", 2, "1er mars"), ("31 déc", 1, "1er janv"), ("août 2026", 31, "septembre 2026"), ("30 février 2020", 1, None), ("sept lieues", 1, None),
    ],
)
def test_dates_in_more_hands(text, days, moved):
    assert dates.shift_text(text, days) == moved


def test_dates_inside_texts():
    text = "seen on 12 mars 2019, again 2020-01-31T10:00Z and 3/4/2021; id 12-34-56-2020 v1.2.2020.3"
    assert [text[a:b] for a, b in dates.dates_in(text)] == ["12 mars 2019", "2020-01-31T10:00Z", "3/4/2021"]
    assert dates.shift_inside("from 2020-01-01 to 3 mars 2020", 10) == "from 2020-01-11 to 13 mars 2020" and dates.shift_inside("no date", 1) is None
    assert dates.tightened("on 2020-01-01,") == (3, 13) and dates.tightened("2020-01-01 or 2020-01-02") == (0, 24)
    began = time.time()
    for t in ("a-" * 50_000, "x" * 100_000, "1 " * 30_000 + "mars 2020", "12/" * 30_000, "2020-01-01 " * 10_000):
        dates.dates_in(t)
    assert time.time() - began < 3


def test_dates_stay_on_their_side_of_today():
    today = datetime.date(2024, 6, 15)
    for days in (200, 700, -400):
        past = [dates.moved(dates.read(f"20{y:02d}-03-04"), days, today) for y in range(25)]
        later = [dates.moved(dates.read(f"20{y:02d}-03-04"), days, today) for y in range(25, 60)]
        assert all(d <= today for d in past) and all(d > today for d in later) and len(set(past + later)) == 60


def test_dates_of_a_column(spark):
    rows = spark.createDataFrame([("2020-01-31",), ("le 3 mars 2020",), ("none",), (None,)], "t string")
    assert [r[0] for r in rows.select(dates.shifted(F.col("t"), F.lit(10))).collect()] == ["2020-02-10", "le 13 mars 2020", None, None]
    found = rows.select(dates.dated(F.col("t")).alias("d")).collect()
    assert [[x["value"] for x in r["d"] or []] for r in found] == [["2020-01-31"], ["3 mars 2020"], [], []]


# Detection


def test_long_words_take_no_quadratic_time(spark):
    evil = ["a-" * 20_000, "b" * 40_000 + " @c.com .com", "a." * 20_000 + "com@", "eyJ-" * 10_000, "svc-" * 10_000, "-----BEGIN A-----" * 2_000, "1" * 40_000, "ghp_" * 10_000, "+1 " * 13_000, "a" * 40_000 + "@" + "b." * 20_000]
    df = spark.createDataFrame([(t,) for t in evil], "text string")
    df.limit(1).select(detect.spans_of("text")).collect()
    began = time.time()
    df.coalesce(1).select(F.size(detect.spans_of("text"))).collect()
    assert time.time() - began < 1.0 * len(evil)


def test_marks_in_texts_do_no_harm(spark):
    text = "\ufdd0a@b.co\ufdd1 \U0001f600 c@d.co"
    got = spark.createDataFrame([(text,)], "text string").select(F.explode(detect.spans_of("text")).alias("s")).select("s.*").where("type = 'EMAIL_ADDRESS'").collect()
    assert [(r["value"], text[r["start"] : r["end"]]) for r in got] == [("a@b.co", "a@b.co"), ("c@d.co", "c@d.co")]


def test_many_spans_settle_island_by_island(spark):
    spans = [("HOSTNAME", "x", 10 * i, 10 * i + 6, 0.8) for i in range(3000)] + [("URL", "x", 10 * i, 10 * i + 4, 0.8) for i in range(0, 3000, 3)]
    df = spark.createDataFrame([(spans, "y" * 30_000)], f"s {SPANS}, t string")
    began = time.time()
    got = df.select(resolved(F.col("s"), "t").alias("r")).first()["r"]
    assert len(got) == 3000 and time.time() - began < 20


def test_models_guards_and_scaffolding(spark):
    texts = spark.createDataFrame([(1, "Ann-Mary Lee lives at 12 rue de la Paix since 2020"), (2, "nothing")], "doc_id bigint, text string")

    def model(batch):
        return [[("Person", 0, 3, 0.9), ("person", 4, 8, 0.8), ("person", 9, 12, 0.7), ("address", 22, 39, 0.4), ("org", 0, 3, 0.9), ("date", 13, 18, 0.9)] if t.startswith("Ann") else [] for t in batch]

    got = detect.with_model(texts, model).collect()
    assert [(x["type"], x["value"], x["score"]) for x in got[0]["spans"]] == [("PERSON", "Ann-Mary Lee", 0.7)] and got[1]["spans"] == []
    row = spark.createDataFrame([([("PERSON", "Ann Lee\n  12\tBob", 5, 21, 0.9)],)], f"s {SPANS}")
    assert [(x["value"], x["start"], x["end"]) for x in row.select(detect.cut_at_scaffolding(F.col("s"))).first()[0]] == [("Ann Lee", 5, 12), ("Bob", 18, 21)]
    text = "Dr. Jane Smith, contact: Paul de Vries, 12 rue de la Paix, 75002 Paris or 5 Baker Street and Hauptstraße 7, 10115 Berlin"
    found = spark.createDataFrame([(text,)], "text string").select(F.explode(detect.spans_of("text", detect.strategy("filtered", ("PERSON", "ADDRESS")))).alias("s")).select("s.*").collect()
    assert [r["value"] for r in found] == ["Dr. Jane Smith", "Paul de Vries", "12 rue de la Paix, 75002 Paris", "5 Baker Street", "Hauptstraße 7, 10115 Berlin"]
    with pytest.raises(ValueError, match="unknown strategy"):
        detect.strategy("other")
    assert detect.distinct_texts(texts.union(texts)).count() == 2


def test_reasons_at_detection(spark):
    docs = spark.createDataFrame([(1, "see https://example.com/acme/lib and acme/ours now")], "doc_id bigint, text string")
    spans = spark.createDataFrame([(1, "REPO", "lib", 29, 32, 0.9), (1, "REPO", "acme/ours", 37, 46, 0.9)], "doc_id bigint, type string, value string, start int, end int, score double")
    got = detect.reason_public(spans, docs, rules.Inventory.parse([(1, "ours")]), rules.AllowList.parse([(1, "lib")])).collect()
    assert {r["value"]: r["reason"] for r in got} == {"lib": "exact", "acme/ours": None}


# Surrogates


def allocated(spark, kind, values):
    return vault.allocate(vault.entities(spark.createDataFrame([(kind, v) for v in values], "type string, value string")), "s", KEYS)


def test_shared_attributes_stay_apart_and_together(spark):
    hosts = [f"db{k}.zone{i}.corp.com" for i in range(120) for k in range(2)] + [f"a@zone{i}.corp.com" for i in range(0)]
    view = {r["real"]: r["surrogate"] for r in vault.view(allocated(spark, "HOSTNAME", hosts), "s", KEYS).collect()}
    zones = {}
    for h, s in view.items():
        zones.setdefault(h.split(".", 1)[1], set()).add(s.split(".", 1)[1])
    # Of the two hosts of one short name per zone only one key exists; each zone has one zone of its own.
    assert all(len(z) == 1 for z in zones.values()) and len({min(z) for z in zones.values()}) == len(zones)
    ips = [f"10.{a}.{b}.{c}" for a in (1, 2) for b in range(40) for c in (1, 2, 200)] + [f"93.{a}.{b}.7" for a in range(30) for b in range(30)]
    view = {r["real"]: r["surrogate"] for r in vault.view(allocated(spark, "IP_ADDRESS", ips), "s", KEYS).collect()}
    nets = {}
    for v, s in view.items():
        nets.setdefault(v.rsplit(".", 1)[0], set()).add(s.rsplit(".", 1)[0])
        assert s.startswith("10.") == v.startswith("10.") and (v.startswith("10.") or s.split(".")[0] in {"198", *map(str, range(240, 256))})
    assert len(view) == len(ips) and all(len(n) == 1 for n in nets.values()) and len({min(n) for n in nets.values()}) == len(nets) == 980


@pytest.mark.parametrize(("kind", "make"), [("PHONE_NUMBER", lambda i: f"+33 6 {i // 10**6 % 100:02d} {i // 10**4 % 100:02d} {i // 100 % 100:02d} {i % 100:02d}"), ("PERSON", lambda i: f"Name{i}"), ("HOSTNAME", lambda i: f"h{i}x.corp.com"), ("EMAIL_ADDRESS", lambda i: f"u{i}@c{i % 700}.com")])
def test_spaces_are_wide_enough(spark, kind, make):
    n = 6000
    m = allocated(spark, kind, [make(i) for i in range(n)]).where("not startswith(etype, '_')")
    assert m.count() == n == m.select("surrogate").distinct().count()
    if kind == "PHONE_NUMBER":
        assert m.where(~F.col("surrogate").rlike(r"\A\+33 (0|1 99 00|2 61 91|3 53 01|4 65 71|5 36 49|6 39 98)")).count() == 0


def test_more_kinds_of_surrogates(spark):
    g, zero = Generator(b"salt"), F.lit(0)
    six = one(spark, can.canonical(F.lit("IP_ADDRESS"), F.col("v")), v="2001:DB8::1")
    assert six["key"] == "ip:2001:0db8:0000:0000:0000:0000:0000:0001" and six["attrs"]["subnet"] == "2001:0db8:0000:0000" and six["attrs"]["v"] == "6"
    assert all(one(spark, can.ipv6_groups(F.col("v")), v=v) is None for v in ("1.2.3.4", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7", "a:b")) and one(spark, can.ipv6_groups(F.col("v")), v="::1%eth0")[7] == "0001"
    view = {r["real"]: r["surrogate"] for r in vault.view(allocated(spark, "IP_ADDRESS", ["2a01:e0a::1", "2a01:e0a::2", "10.1.0.0/16", "93.4.5.0/24"]), "s", KEYS).collect()}
    assert view["2a01:e0a::1"].startswith("2001:db8:") and view["2a01:e0a::1"].split(":")[:4] == view["2a01:e0a::2"].split(":")[:4] and view["2a01:e0a::1"] != view["2a01:e0a::2"]
    assert view["10.1.0.0/16"].startswith("10.") and view["10.1.0.0/16"].endswith(".0.0/16") and view["93.4.5.0/24"].endswith(".0/24")
    path = one(spark, g.path(F.col("v"), zero), v="/home/jdoe/src/acme-report.tar.gz")
    assert path.startswith("/home/") and "/src/" in path and path.endswith(".tar.gz") and "jdoe" not in path and "acme" not in path
    assert one(spark, g.path(F.col("v"), zero), v="C:\\Users\\jane\\x.txt").startswith("C:\\Users\\")
    address = one(spark, g.address(F.col("v"), zero), v="12 rue de la Paix, 75002 Paris")
    assert address.split(" ")[1:4] == ["rue", "de", "la"] and "Paix" not in address and "Paris" not in address and len(address.split(",")[1].split()[0]) == 5
    assert one(spark, g.organisation(F.col("v"), zero), v="Acme Widgets GmbH").endswith(" GmbH")
    assert one(spark, can.nfc(F.col("v")), v="e\u0301") == "é"


# Policy and mapping


def test_policy_files_answers_and_scopes(spark, tmp_path):
    good, bad = tmp_path / "g.json", tmp_path / "b.json"
    good.write_text(json.dumps({"type": {"HOSTNAME": "reveal", "URL": "open"}, "class": {"secret": "reveal", "pii": "reveal"}}))
    bad.write_text("{broken")
    table = policy.from_files(spark, {"global": str(good), "session": str(bad), "project": str(tmp_path / "none")})
    assert sorted(map(tuple, table.collect())) == [("global", "class", "pii", "reveal"), ("global", "type", "HOSTNAME", "reveal")]
    answers = spark.createDataFrame([(1, "type", "URL", "reveal"), (2, "type", "URL", "anonymise"), (3, "type", "REPO", "reveal"), (4, "type", "REPO", None)], "seq int, granularity string, key string, decision string")
    assert [tuple(r) for r in policy.answered(answers).collect()] == [("message", "type", "URL", "anonymise")]
    assert policy.scope_name("a", "b/c d") != policy.scope_name("ab", "/c d") and policy.scope_name("x", "/home/me/proj").startswith("proj-")
    ruled = policy.on_value(table, "global", "EMAIL_ADDRESS", " a@b.co ", "reveal", KEYS)
    assert policy.decide(spark.createDataFrame([("EMAIL_ADDRESS", "a@b.co")], "type string, value string"), ruled.where("granularity = 'value'"), KEYS).first()["decision"] == "reveal"
    setting = "level string, name string, value string"
    assert policy.valid_settings(spark.createDataFrame([("env", "mode", "ask")], setting)).first()["value"] == "ask"
    with pytest.raises(Exception, match="invalid setting"):
        policy.valid_settings(spark.createDataFrame([("env", "mode", "never")], setting)).collect()


def test_stored_mappings(spark, tmp_path):
    path = str(tmp_path / "map")
    m = allocated(spark, "HOSTNAME", ["a.corp.com", "b.corp.com"])
    vault.save(m, path)
    back = vault.stored(spark, path)
    assert vault.version(back).first() == vault.version(m).first() != vault.version(m.limit(1)).first()
    (tmp_path / "map" / "_lock").touch()
    with pytest.raises(RuntimeError, match="another writer"):
        vault.save(m, path)
    plain = spark.createDataFrame([("canon:host", "host:a", "a.corp.com", "x.test"), ("canon:host", "host:c", "c.corp.com", "x.test"), ("canon:host", "host:d", "d.corp.com", "y.test")], "etype string, key string, real string, surrogate string")
    plain.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="sealed"):
        vault.stored(spark, str(tmp_path / "plain"))
    sealed, counts = vault.migrated(plain, "s", KEYS)
    assert tuple(counts.first()) == (3, 2, 1) and {r["surrogate"] for r in vault.view(sealed, "s", KEYS).collect()} == {"x.test", "y.test"}
    values = spark.createDataFrame([("A.corp.com",), ("z.corp.com",)], "value string")
    assert [r["value"] for r in vault.present(values, m, "s", KEYS).collect()] == ["A.corp.com"]
    shown = policy.shown(spark.createDataFrame([(m.where("not startswith(etype, '_')").first()["surrogate"],), ("none",)], "surrogate string"), vault.view(m, "s", KEYS)).collect()
    assert sorted(str(r["value"]) for r in shown)[0] == "None" and len(shown) == 2


# Rules, sources, streams and reports


def test_predicates(spark):
    t = lambda c, v: one(spark, c, v=v)
    v = F.col("v")
    assert [t(rules.is_port(v), x) for x in ("80", "65536", "99999", "x", "")] == [True, False, False, False, False]
    assert [t(rules.bare_path(v), x) for x in ("/", "/home", "/usr/local/bin", "/home/jane")] == [True, True, True, False]
    assert [t(rules.is_local(v), x) for x in ("http://localhost:1/x", "http://127.9.9.9", "http://[::1]:80/", "http://127.0.0.1.evil.com/", "http://localhost@evil.com", "x")] == [True, True, True, False, False, False]
    assert [t(rules.is_open_host(v, ["pypi.org"]), x) for x in ("pypi.org", "files.PYPI.org.", "evilpypi.org", "org")] == [True, True, False, False]
    assert [t(rules.curated_extension(v), x) for x in ("a.py", "a.b.py", ".py", "acme.corp")] == [True, False, False, False]
    assert [t(rules.opaque_segment(v), x) for x in ("123", "deadbeef", "report", "a1b2c3d4e5")] == [True, True, False, True]
    hosts = spark.createDataFrame([("a.x.com",), ("x.com",), ("b1.y.org",)], "host string")
    assert {r["host"]: r["glob"] for r in rules.justified(hosts, ["*.x.com", "b?.y.org"]).collect()} == {"a.x.com": "*.x.com", "b1.y.org": "b?.y.org"}
    allow = rules.AllowList.parse([(1, "example.com"), (2, "Acme"), (3, "types:URL lib"), (4, "re:x+")])
    rows = spark.createDataFrame([("H", "EXAMPLE.com"), ("H", "acme"), ("H", "Acme"), ("URL", "lib"), ("H", "lib"), ("H", "xx"), (None, None)], "k string, v string")
    joined = [(r["v"], r["reason"]) for r in allow.with_reason(rows, "k", "v").collect()]
    plain = [(r["v"], r["r"]) for r in rows.select("v", allow.reason(F.col("k"), F.col("v")).alias("r")).collect()]
    assert sorted(map(str, joined)) == sorted(map(str, plain))


def streamed(spark, df, out, tmp_path):
    name = "t" + uuid.uuid4().hex
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = out(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams_hold_nothing_without_bound(spark, tmp_path):
    rows = [("s", 0, 0, "json", "x" * 50), ("s", 0, 1, "json", "y" * 60), ("s", 1, 5, "text", "waits for ever " * 10), ("s", 2, 0, "odd", "z"), ("s", 3, 0, "raw", "a web\nb"), ("s", 3, 1, "stop", "")]
    df = spark.createDataFrame(rows, "stream_id string, block int, seq bigint, kind string, text string")
    got = streamed(spark, df, lambda s: restore.restored_stream(s, {"web": "real"}, most_held=100), tmp_path)
    by = {(r["block"], r["error"]): r["text"] for r in got}
    assert by[0, "too large"] == "x" * 50 + "y" * 60 and (1, "too large") in by and by[2, "unknown kind"] == "z" and by[3, None] == "a real\nb"


def test_silent_blocks_are_closed(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, 0, "text", "the end of it"), ("s", 1, 3, "text", "early web")], "stream_id string, block int, seq bigint, kind string, text string")
    df.write.parquet(str(tmp_path / "in"))
    name = "t" + uuid.uuid4().hex
    query = restore.restored_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), {"web": "real"}, silence=1).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    began, got = time.time(), []
    while len(got) < 2 and time.time() - began < 60:
        time.sleep(1)
        got = [r for r in spark.sql(f"SELECT * FROM {name}").collect() if r["error"]]
    query.stop()
    assert {r["block"]: r["error"] for r in got} == {0: "inactive", 1: "inactive"} and {r["text"] for r in got if r["block"] == 1} == {"early real"}


def test_blocks_of_a_stream_in_chunks(spark, tmp_path):
    text = "data: a\n\ndata: b\r\n\r\ndata: c\n\n\ndata: unfinished"
    df = spark.createDataFrame([("s", i, text[i : i + 3]) for i in range(0, len(text), 3)], "stream_id string, seq bigint, data string")
    got = streamed(spark, df, readers.stream_blocks, tmp_path)
    assert [r["block"].strip() for r in sorted(got, key=lambda r: r["n"])] == ["data: a", "data: b", "data: c"]


def test_sources_strict_and_lenient(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.strict_lines(spark, str(path), "a int").count() == 2
    path.write_text('{"a": 1}\n{"a": 3}\n{broken\n{"a": 2}')
    assert [r["a"] for r in readers.last_lines(spark, str(path), "a int", "a", 2).collect()] == [3, 2]
    with pytest.raises(Exception):
        readers.strict_lines(spark, str(path), "a int").collect()
    good, rest = readers.bodies(spark.createDataFrame([('{"a":1}',), ("[1]",), ("x",), (None,)], "body string"))
    assert good.count() == 1 and {r["error"] for r in rest.collect()} == {"no JSON object"} and rest.count() == 3


def test_more_reports(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    c = reports.pipeline_counters(df([("a", 2, 1), ("a", 2, 1), ("b", 0, 0)], "text string, n_spans int, n_entities int")).first()
    assert tuple(c) == (3, 1, 4, 2)
    assert {r["path"]: r["n"] for r in reports.path_counters(df([("/a?x", 1), ("/a", 2), ("/b", 3)], "path string, bytes_out bigint")).collect()} == {"/a": 2, "/b": 1}
    r = reports.detectors_compared(df([(1, "Jane Smith"), (1, "Paris")], "id int, value string"), df([(1, "Jane")], "id int, value string"), df([(1, "Paris"), (1, "x")], "id int, value string")).first()
    assert (r["n"], r["by_a"], r["by_b"], r["only_a"], r["only_b"]) == (2, 1, 1, 1, 1)
    r = reports.escalation_precision(df([(1, True), (2, True), (3, False)], "id int, escalated boolean"), df([(1, "a", "b", "a"), (2, "a", "a", "a"), (3, "a", "b", "a")], "id int, expected string, before string, after string")).first()
    assert (r["n"], r["right"], r["precision"]) == (2, 1, 0.5)
    got = reports.unrestored(df([(1, "see db1.acme.internal and web.fern.example now")], "id int, text string"), df([("db1.acme.internal",)], "host string")).collect()
    assert [r["value"] for r in got] == ["web.fern.example"]
    n = {r["value"]: r["n"] for r in reports.occurrences(df([("xx db1/a\\/b secretive secret",), ("db1",)], "body string"), df([("db1",), ("a/b",), ("secret",), ("none",), ("ret",)], "value string")).collect()}
    assert n == {"db1": 2, "a/b": 1, "secret": 2, "none": 0, "ret": 2}
    assert sorted(r["value"] for r in reports.declared_values(df([("x",)], "value string"), df([('password = "hunter2"',)], "text string")).collect()) == ["hunter2", "x"]
    halves = {r["half"]: r["median"] for r in reports.latency_halves(df([(float(i), i) for i in range(10)], "v double, at int"), "v", "at").collect()}
    assert halves == {"first": 2.0, "second": 7.0}
    leaves = walk.flattened(df([(1, '{"a": {"b": [1, "x"]}}'), (2, "bad")], "id int, j string"), "j", "id").collect()
    assert [(r["path"], r["value"]) for r in leaves] == [("a.b[]", "1"), ("a.b[]", "x")]
