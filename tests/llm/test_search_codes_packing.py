"""Vector codes, packing and lexical search against brute force, and their edge cases."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


from veilmill.llm import lexical_search, packing, vector_codes
from veilmill.llm.common import bucketed

ROOT = "/root/testdata"
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# Vector codes


def lloyd(rows):
    """The contract's rounds in Python's whole numbers; rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(c * 1024) if abs(c) < 2**40 else int(c) * 1024 for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][1])
    bounds = [p * width // 4 for p in range(5)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    books = [[r[1][bounds[p] : bounds[p + 1]] for r in order[:256]] for p in range(4)]

    def near(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v[bounds[p] : bounds[p + 1]], e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(4):
        found = [[near(p, v)[0] for _, v, _ in kept] for p in range(4)]
        for p in range(4):
            for e in range(len(books[p])):
                of = [v[bounds[p] : bounds[p + 1]] for (_, v, _), c in zip(kept, found[p], strict=True) if c == e]
                if of:
                    books[p][e] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    out = []
    for i, v, lab in kept:
        each = [near(p, v) for p in range(4)]
        out.append((i, "".join(f"{c:02x}" for c, _ in each), sum(e for _, e in each), lab))
    by = Counter()
    for _, _, e, lab in out:
        by[lab] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    most = 2**63 - 1
    return sorted(((i, code, min(e, most), min(by[lab], most), sha) for i, code, e, lab in out), key=str)


def codes_of(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, entry int")
    return sorted(map(tuple, vector_codes.compress(df).drop("label").collect()), key=str)


def test_codes_are_those_of_brute_force_with_nulls_repeats_and_ties(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(j % 3, 0.3))) for _ in range(8)], None if j % 7 == 0 else j % 4) for j, i in enumerate([*range(400), 7, 7, None, None])]
    rows += [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 2)]
    rows += [(600 + i, [0.25] * 8, 3) for i in range(300)]  # equal vectors
    rng.shuffle(rows)
    assert codes_of(spark, [(*r, "x", 1) for r in rows]) == lloyd(rows)


@pytest.mark.parametrize("width", [1, 6, 64])
def test_codes_of_few_rows_and_widths_that_four_does_not_divide(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(width)], 0) for i in range(5)]
    assert codes_of(spark, [(*r, None, None) for r in rows], "double") == lloyd(rows)


def test_codes_of_huge_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e-3, 1.0, 3e5, 2.0**60, -1e300]) * rng.random() for _ in range(4)], i % 2) for i in range(300)]
    assert codes_of(spark, [(*r, None, None) for r in rows], "double") == lloyd(rows)


def test_other_widths_have_no_code_and_an_empty_table_none(spark):
    rows = [(1, [1.0] * 4, 0, "", 0), (2, [2.0] * 4, 0, "", 0), (3, [1.0] * 8, 0, "", 0)]
    got = codes_of(spark, rows)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, "00000000", 0, 0), (2, "01010101", 0, 0), (3, None, None, 0)]
    assert codes_of(spark, []) == []
    assert [r[1:3] for r in codes_of(spark, [(1, [], 0, "", 0), (2, [], 0, "", 0)])] == [("00000000", 0)] * 2


def test_a_round_shuffles_no_vector_and_only_what_changed(spark):
    vectors = spark.read.parquet(f"{ROOT}/sf0.001/embeddings.parquet")
    blocks, width, books = vector_codes.train(vectors)
    step = vector_codes._round(width, True, books)
    codes = bucketed(blocks.select("block", "x").mapInArrow(step, vector_codes.ROUND), "test-codes", 8, "block")
    again = blocks.select("block", "x").join(codes.where("codes is not null").select("block", "codes"), "block")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    settled = again.mapInArrow(step, vector_codes.ROUND)  # same codebooks, so nothing changes and nothing is sent
    assert settled.where("part is not null").count() == 0 and settled.count() == blocks.count()
    coded = vector_codes.assigned(blocks, width, books, True)
    near = vector_codes.decode(coded, books).join(vectors.select("vec_id", "embedding"), "vec_id").select(F.avg(F.expr("aggregate(zip_with(vector, embedding, (a, b) -> (a - b) * (a - b)), 0d, (s, x) -> s + x)")), F.avg(F.expr("aggregate(embedding, 0d, (s, x) -> s + x * x)"))).first()
    assert near[0] < near[1] / 2


# Packing


def plain_best_fit(lengths, capacity):
    room, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, n)
        if i == len(room):
            bins += 1
            bisect.insort(room, capacity - n)
        else:
            bisect.insort(room, room.pop(i) - n)
    return bins, sorted(room)


@pytest.mark.parametrize("seed", range(30))
def test_the_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100, 2048])
    shape = rng.choice([lambda: rng.randint(1, capacity), lambda: max(1, int(capacity * rng.random() ** 4)), lambda: rng.choice([1, capacity // 3 + 1, capacity // 2, capacity])])
    lengths = [shape() for _ in range(rng.randint(0, 800))]
    bins: dict[int, list[tuple[int, int]]] = {}
    seen = Counter()
    for length, rank, n, per, first, offset in packing.plan(Counter(lengths), capacity):
        assert rank == seen[length]
        seen[length] += n * per
        for j in range(n * per):
            bins.setdefault(first + j // per, []).append((offset + j % per * length, length))
    assert seen == Counter(lengths)
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    expected, room = plain_best_fit(lengths, capacity)
    assert (len(bins), sorted(capacity - sum(n for _, n in h) for h in bins.values())) == (expected, room)


def direct(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_packed_documents_are_whole_and_few(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["", None, "word " * 5_000, "x" * 9_000, "á J̌ İİ Å", "it's DON'T 've'll ''s a'S.'s 's", "1a2.b,3 '4's _x_ --y", "<|endoftext|> t<|startoftext|>", "\x00\x1f a\x0bb\x85c d", "中文 ไทย", "<|endoftext", "same", "same"]
    rows = [(i if i % 5 else None, t, "clash", 7) for i, t in enumerate(texts)] + [(1, "same", "clash", 7)] * 3
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, piece string, rank int"), TOKENIZER, ids=True)
    found = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got.collect())
    expected = Counter()
    for i, t, *_ in rows:
        ids = direct(tokenizer, t)
        for p in range(-(-len(ids) // 2048)):
            some = np.array(ids[p * 2048 : (p + 1) * 2048], "<u4")
            expected[i, p, p * 2048, len(some), zlib.crc32(some.tobytes()), some.tobytes()] += 1
    assert found == expected
    whole = packing.sequences(got).collect()
    assert len(whole) == plain_best_fit([r["length"] for r in got.collect()], 2048)[0] and all(len(r["ids"]) <= 4 * 2048 for r in whole)
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in got.collect())
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_packing_of_the_smallest_table(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet")
    rows = packing.packed(docs, TOKENIZER).collect()
    ids = {r["doc_id"]: direct(tokenizer, r["text"]) for r in docs.collect()}
    assert Counter(r["doc_id"] for r in rows) == {d: -(-len(x) // 2048) for d, x in ids.items()}
    for r in rows:
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    for s in {r["sequence_id"] for r in rows}:
        held = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and held[0][0] == 0 and sum(held[-1]) <= 2048
    assert len({r["sequence_id"] for r in rows}) == plain_best_fit([r["length"] for r in rows], 2048)[0]


def test_words_are_encoded_alone_only_where_that_is_the_same():
    model = open(TOKENIZER, encoding="utf-8").read()
    assert packing._cuts_words(model)
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_str(model), random.Random(3)
    parts = ["a", "B", "'", "s", "'S", "re", ".", "!", " ", "\n", "1", "é", "é", "́", " ", "<|", "|>", "-", "_", "中", "ё", "Ж", "×", "÷", "÷,", "ñ", "Ö", "ẞ", "Ǩ", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3_000)]
    flat, each = zip(*((f, n) for _, f, n in packing.encoded(pa.array(texts), model, True)), strict=True)
    ends = np.cumsum(np.concatenate(each))
    flat = np.concatenate(flat).tolist()
    assert [flat[e - n : e] for e, n in zip(ends, np.concatenate(each), strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not packing._cuts_words(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


# Lexical search


def brute(docs, items, k=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    bags = [(d, Counter(pattern.findall((t or "").translate(low)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(pattern.findall((t or "").translate(low)))
    out = []
    for i, terms in wanted.items():
        scores = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, terms string, n int")
    i = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, term string")
    return sorted(map(tuple, lexical_search.search(d, i, k).collect()), key=str)


def test_search_is_that_of_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{int(200 * rng.random() ** 3)}" for _ in range(4_000)]
    docs = [(i if i % 50 else None, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(600)]
    docs += [(3, None), (4, ""), (5, "... !!"), (7, docs[8][1]), (7, docs[8][1]), (9, "Über STRASSE naïve café 1,5 中文"), (10, "w1 " * 40_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(40)] + [(1, "more Words w3"), (None, "w5 w6"), (None, "w7"), (90, None), (91, "unheard of"), (92, "über ÜBER straße strasse NAïVE 中文 5")]
    got = searched(spark, docs, items)
    assert got == brute(docs, items)
    assert searched(spark, docs, items, 3) == brute(docs, items, 3)


def test_search_in_several_blocks_and_of_empty_tables(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 9)))) for i in range(80)]
    items = [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(6))) for i in range(12)]
    monkeypatch.setattr(lexical_search, "ENTRIES", 10)
    monkeypatch.setattr(lexical_search, "CELLS", 30)
    assert searched(spark, docs, items) == brute(docs, items)
    assert searched(spark, [], items) == [] == searched(spark, docs, [])
    assert searched(spark, [(1, "a")], [(1, "a"), (2, "b")]) == brute([(1, "a")], [(1, "a"), (2, "b")])


def test_thresholds_are_lower_bounds_and_prune(spark):
    docs, items = (spark.read.parquet(f"{ROOT}/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    terms = lexical_search.item_terms(items)
    rows, n = lexical_search._with_m(lexical_search.index(docs, terms))
    own = {r["item_id"]: r for r in lexical_search.seeded(terms, lexical_search.term_statistics(rows), n).collect()}
    last = {r["item_id"]: r["score"] for r in lexical_search.search(docs, items).where("rank = 10").collect()}
    assert all(own[i]["threshold"] <= last[i] for i in last)
    assert sum(not t["kept"] for r in own.values() for t in r["terms"]) > 0
    assert all(r["rest"] < r["threshold"] or r["rest"] == 0 for r in own.values())
