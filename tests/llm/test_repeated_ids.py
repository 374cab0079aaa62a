"""N-gram join and line dedup against brute force where doc_ids repeat with other texts, and where lines repeat without end."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilmill.llm import common, line_dedup, ngram_join

DOCS = "doc_id bigint, text string, sign string, seal bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """Smallest doc_id that links reach from each row, sets by sets; rows with a null doc_id link nothing."""
    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common_size = len(a & sets[j])
            if a and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * common_size >= 80 * (len(a) + len(sets[j]) - common_size):
                name[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def joined(spark, rows):
    return sorted(map(tuple, ngram_join.near_duplicates(docs_of(spark, rows)).collect()), key=str)


def test_texts_of_one_id_are_sets_of_their_own(spark):
    t1, t2 = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    t3 = " ".join([*t1.split()[:20], *t2.split()[:20]])
    rows = [(1, t1), (1, t2), (2, t3), (3, t1), (4, t2)]
    assert joined(spark, rows) == brute_components(rows) == [(1, 36, 1), (1, 36, 1), (2, 36, 2), (3, 36, 1), (4, 36, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_join_with_repeated_and_null_ids_is_that_of_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [[f"{c}{i}" for i in range(rng.randint(3, 120))] for c in "abcdefgh"]
    rows = []
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"z{rng.randint(0, 2)}"
        rows.append((rng.choice([None, *range(40)]), " ".join(words)))
    rows += [(7, None), (7, ""), (None, None), (8, "one two"), (9, "ONE two"), *rows[:5]]
    assert joined(spark, rows) == brute_components(rows)


# Line dedup


def words_of(line):
    return len(re.findall("[^\x20\x09-\x0d]+", line))


def brute_lines(rows):
    """Positions that go from each distinct (doc_id, text): lines of a run of 10 words or more that an earlier document has in a run too."""
    texts = sorted({(d, line_order(t), t) for d, t in rows if d is not None and t is not None})
    out, seen = {}, set()
    for d, _, t in texts:
        lines, gone, runs = t.split("\n"), set(), set()
        counts = [words_of(x) for x in lines]
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += counts[j]
                if n >= 10:
                    runs.add((i, j + 1))
                    break
        for j in range(len(lines)):
            n = 0
            for i in range(j, -1, -1):
                n += counts[i]
                if n >= 10:
                    runs.add((i, j + 1))
                    break
        for i, j in runs:
            if tuple(lines[i:j]) in seen:
                gone |= set(range(i, j))
        seen |= {tuple(lines[i:j]) for i, j in runs}
        out[d, t] = sorted(gone)
    return out


ORDER = {}


def line_order(text):
    return ORDER[text]


def deduped(spark, rows):
    docs = docs_of(spark, rows)
    ORDER.update({r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})
    expected = brute_lines(rows)
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(rows)
    plain = lambda r: (str(r["doc_id"]), r["n_lines"], str(r["removed_lines"]), str(r["text"]))
    wanted = []
    for d, t in rows:
        gone = expected.get((d, t), [])
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        wanted.append((str(d), 0 if t is None else t.count("\n") + 1, str(gone), str(left)))
    assert sorted(map(plain, got)) == sorted(wanted)
    return {(r["doc_id"], r["n_lines"]): r["text"] for r in got}


def test_no_row_loses_a_line_for_another_row_of_its_id(spark):
    line = "a shared line that has quite a few words in it"
    rows = [(1, line), (2, f"{line} and more\n{line}\nlast"), (2, "unique words that stand nowhere else in here at all\nkeep me")]
    assert deduped(spark, rows)[2, 2] == "unique words that stand nowhere else in here at all\nkeep me"


@pytest.mark.parametrize("seed", range(3))
def test_lines_that_go_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 2, 4, 7, 12]))) for _ in range(40)]
    rows = []
    for _ in range(80):
        at = rng.randrange(30)
        rows.append((rng.choice([None, *range(30)]), "\n".join([*rng.choices(pool, k=rng.randint(0, 3)), *pool[at : at + rng.randint(0, 8)], *rng.choices(pool, k=rng.randint(0, 3))])))
    deduped(spark, [*rows, *rows[:3], (1, None), (None, None), (2, "")])


def test_the_smallest_table_loses_what_brute_force_says(spark):
    rows = [tuple(r) for r in common.load(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    deduped(spark, rows)


def test_thousands_of_equal_lines_take_no_quadratic_time():
    a, b = [1, 2] * 20_000, [2, 1, 1] * 15_000
    began = time.time()
    assert line_dedup.common_lines(a, b, [4, 6] * 20_000)
    assert line_dedup.common_lines([5] * 30_000, [5], [3] * 30_000) == []
    assert time.time() - began < 10
