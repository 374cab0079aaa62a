import random

from veilmill.operators import reports


def counted(spark, bodies, values):
    frame = lambda rows, name: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    return reports.occurrences(frame(bodies, "body"), frame(values, "value"))


def brute(bodies, values):
    forms = lambda v: {v, v.replace("/", "\\/")}
    return {v: sum(b.count(f) for b in bodies if b for f in forms(v)) for v in values if v}


def test_values_of_any_length_and_script(spark):
    text = "\U0001d11e" * 3 + "ключ и ключи / a/b a\\/b aaaaaaa\n\U0001d11eж db1"
    bodies = [text, text, None, "", "x" * (reports.BLOCK - 2) + "ключ", "x" * (reports.BLOCK - 1) + "ж/у", "ab" * 40000]
    values = ["к", "ю", "кл", "люч", "ключ", "ключи", "/", "a/b", "ж/у", "aa", "aaa", "aaaa", "\U0001d11e", "\U0001d11eж", "\n", " ", "none", "щ", "db1", "abab", "ba" * 30000, None, "", "ключ"]
    out = counted(spark, bodies, values).collect()
    assert {r["value"]: r["n"] for r in out} == brute(bodies, values) and len(out) == len(brute(bodies, values))


def test_random_values(spark):
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abж/\U0001d11e") for _ in range(n))
    bodies, values = [make(r.randrange(300)) for _ in range(40)], [make(r.randrange(1, 8)) for _ in range(120)]
    assert {x["value"]: x["n"] for x in counted(spark, bodies, values).collect()} == brute(bodies, values)


def test_empty_tables_and_no_nested_loop(spark):
    assert counted(spark, ["a"], []).count() == 0
    assert [tuple(x) for x in counted(spark, [], ["a"]).collect()] == [("a", 0)]
    plan = counted(spark, ["some body"], ["o", "bo", "body", "ж"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_short_values_move_no_text(spark, monkeypatch):
    written = []
    monkeypatch.setattr(reports, "materialise", lambda df, label, f=reports.materialise: written.append(label) or f(df, label))
    out = {r["value"]: r["n"] for r in counted(spark, ["the cat, the hat"] * 50, ["the", "t", "a/b", "the cat, the hat"]).collect()}
    assert out == {"the": 100, "t": 200, "a/b": 0, "the cat, the hat": 50}
    assert "bodies" not in written


def test_overlaps_over_the_ends_of_pieces(spark):
    r, n = random.Random(7), reports.BLOCK
    runs = lambda size: "".join(r.choice(["a", "ab", "aab", " ", "ж"]) * r.randrange(1, 40) for _ in range(size))
    bodies = ["a" * (3 * n + 5), "ab" * n + "a", "x" * (n - 7) + "aabaab" * 9 + "x" * n + "aaa", *(runs(20) for _ in range(30)), runs(n // 12)]
    values = ["a" * k for k in range(1, 20)] + ["ab" * k for k in range(1, 12)] + ["aba", "baab", "aabaab", "aabaabaab", " " * 7, "жж", "ж" * 17, "xa", "x" * 16, "aax"]
    assert {x["value"]: x["n"] for x in counted(spark, bodies, values).collect()} == brute(bodies, values)


def test_many_counts_are_passed_on_in_parts(spark, monkeypatch):
    from veilmill.functions import needles

    monkeypatch.setattr(needles, "HELD", 64)
    r = random.Random(3)
    texts = ["".join(r.choice("abcdefgh") for _ in range(5000)) for _ in range(40)]
    values = sorted({t[i:i + k] for t in texts[:3] for i in range(0, 300, 7) for k in (1, 2, 3, 5)})
    import pyarrow as pa

    asked = next(needles.asked(iter([pa.RecordBatch.from_arrays([pa.array(range(len(values))), pa.array(values)], ["_id", "needle"])])), None)
    assert asked.num_rows == 1
    keys = {v: int(next(needles._keys(needles._points(v), [len(v)]))[1].view("int64")[0]) for v in values}
    words = needles.np.full(1 << 10, 2**64 - 1, dtype="uint64")
    got = {}
    monkeypatch.setattr(needles, "BLOCK", 2048)
    parts = list(needles.counter([1, 2, 3, 5], words, None)(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0] * len(texts))], ["body", "_row"])])))
    for b in parts:
        for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            got[k] = got.get(k, 0) + x
    assert len(parts) > 1 and {v: got[keys[v]] for v in values} == brute(texts, values)
