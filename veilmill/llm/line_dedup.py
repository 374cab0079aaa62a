"""Line dedup by pairwise alignment.

Documents that overlap are found through the hashes of lines, and of the shortest runs of lines with BLOCK_WORDS words that
start or end at each line: every document with such a line or run is paired with its first holder (smallest doc_id), so each
makes as many pairs as it has later holders, not all pairs of them. Every line of a block that can go lies in such a run of
the block, so a document that has the block first is aligned even where it holds none of its lines first.
Lines that very many documents hold make pairs in the same way; rarity only decides which lines anchor an alignment, as patience diff does: lines that occur once in either document, in an increasing order, then the
ranges between them. Blocks of consecutive lines that the alignment has in common are deleted from the later document.

A line's first holder keeps it, as no earlier document has it, so no text vanishes from the corpus.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words from which a line by itself can pair documents, and from which a common block goes; with runs of lines, any line pairs.
LINE_WORDS, BLOCK_WORDS = 3, 10
#: A word: each letter of a script that sets no blanks between words, and each run of other characters between blanks.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
WORD = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
#: Lines without a character from here on have none of these scripts, so their words are counted without looking scripts up.
SPACED, PLAIN_WORD = r"[\x{0E00}-\x{10FFFF}]", r"[^\x20\x09-\x0D]+"
#: The prime and base of the hashes of runs of lines.
RUN_PRIME, RUN_BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs of positions of equal lines, increasing in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        unique = [(i, at_b[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at_b]
        if not unique:
            # No anchor: each line meets the next place of it in b, as long as there is one.
            places: dict[int, list[int]] = {}
            for j in range(b0, b1):
                places.setdefault(b[j], []).append(j)
            j = b0
            for i in range(a0, a1):
                at = places.get(a[i], [])
                k = bisect_left(at, j)
                if k < len(at):
                    out.append((i, at[k]))
                    j = at[k] + 1
            continue
        # The longest run of anchors that increases in b, by patience sorting.
        tops: list[int] = []
        pile_at: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(unique):
            p = bisect_left(tops, j)
            back.append(pile_at[p - 1] if p else -1)
            if p == len(tops):
                tops.append(j)
                pile_at.append(n)
            else:
                tops[p], pile_at[p] = j, n
        chain, n = [], pile_at[-1]
        while n >= 0:
            chain.append(unique[n])
            n = back[n]
        i0, j0 = a0, b0
        for i, j in reversed(chain):
            out.append((i, j))
            stack.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        stack.append((i0, a1, j0, b1))
    return sorted(out)


def runs(lines: list[int], words: list[int]) -> dict[tuple[int, int], int]:
    """64-bit hashes of the shortest runs of lines with BLOCK_WORDS words that start, or end, at each line, by (start, end)."""
    upto = np.concatenate([[0], np.cumsum(words)])
    # The least end of a run that starts at each line, past all lines where there is none; the last start of one that ends at each.
    ends = np.searchsorted(upto, upto[:-1] + BLOCK_WORDS, "left")
    starts = np.searchsorted(upto, upto[1:] - BLOCK_WORDS, "right") - 1
    spans = {(i, j) for i, j in enumerate(ends.tolist()) if j <= len(lines)} | {(i, j) for j, i in enumerate(starts.tolist(), 1) if i >= 0}
    if not spans:
        return {}
    # A polynomial modulo a prime gives the hash of every run at once, however long it is.
    sums, powers = [0], [1]
    for x in lines:
        sums.append((sums[-1] * RUN_BASE + x) % RUN_PRIME)
        powers.append(powers[-1] * RUN_BASE % RUN_PRIME)
    return {(i, j): (sums[j] - sums[i] * powers[j - i]) % RUN_PRIME * 8 + min(j - i, 7) - (1 << 63) for i, j in spans}


def common_lines(a: list[int], b: list[int], words: list[int]) -> list[int]:
    """Positions in a of the lines of aligned common blocks of BLOCK_WORDS words or more.

    What one alignment leaves unmatched is aligned once more, for blocks that have moved. Lines that were matched apart from their
    block, as where b has them twice or a has it many times, go by the runs of lines that a and b have in common.
    """
    out: list[int] = []
    rest = list(range(len(a)))
    held = set(b)
    for _ in range(2):
        rest = [i for i in rest if a[i] in held]
        matched = [(rest[i], j) for i, j in align([a[i] for i in rest], b)]
        block: list[int] = []
        last = (-2, -2)
        for i, j in [*matched, (-9, -9)]:
            if (i, j) != (last[0] + 1, last[1] + 1):
                if sum(words[k] for k in block) >= BLOCK_WORDS:
                    out += block
                block = []
            block.append(i)
            last = (i, j)
        gone = {i for i, _ in matched}
        rest = [i for i in rest if i not in gone]
    if sum(words[i] for i, x in enumerate(a) if x in held) >= BLOCK_WORDS and len(out) < sum(x in held for x in a):
        # Lines that only b has are in no common run, so their words don't count.
        known = dict(zip(a, words, strict=True))
        in_b = set(runs(b, [known.get(x, 0) for x in b]).values())
        out = sorted({*out, *(i for span, x in runs(a, words).items() if x in in_b for i in range(*span))})
    return out


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if gone := common_lines(r.lines_a.tolist(), r.lines_b.tolist(), r.words_a.tolist()):
                out.append((r.a, gone))
        yield pd.DataFrame(out, columns=["a", "gone"])


def line_table(docs: DataFrame) -> DataFrame:
    """id, doc_id, seal, lines (64-bit hashes), words (per line) of the documents that take part, equal ones once.

    A document is a doc_id with a text, whose hash is seal. ids are in the order of (doc_id, seal), whatever doc_ids repeat.
    """
    text = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("t"))
    each = text.select("doc_id", F.xxhash64("t").alias("seal"), F.split("t", "\n", -1).alias("l"))
    words = F.transform("l", lambda x: F.when(x.rlike(SPACED), F.regexp_count(x, F.lit(WORD))).otherwise(F.regexp_count(x, F.lit(PLAIN_WORD))))
    each = each.select("doc_id", "seal", F.transform("l", lambda x: F.xxhash64(x)).alias("lines"), words.alias("words"))
    each = written(each.dropDuplicates(["doc_id", "seal"]), "dedup-texts")
    order = each.repartitionByRange("doc_id", "seal").sortWithinPartitions("doc_id", "seal")
    return order.select(F.monotonically_increasing_id().alias("id"), *each.columns)


def _with_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch.id, "runs": [sorted(set(runs(a.tolist(), w.tolist()).values())) for a, w in zip(batch.lines, batch.words, strict=True)]})


def overlapping(lines: DataFrame) -> DataFrame:
    """Pairs (a, b), b < a: b is the first document with one of a's lines or runs of lines."""
    single = lines.select("id", F.explode(F.arrays_zip("lines", "words")).alias("l")).where(F.col("l.words") >= LINE_WORDS).select("id", F.col("l.lines").alias("line"))
    several = lines.where("id is not null").mapInPandas(_with_runs, "id bigint, runs array<bigint>").select("id", F.explode("runs").alias("line"))
    held = single.unionByName(several).distinct()
    first = held.groupBy("line").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("b < last").select("line", "b")
    return held.join(first, "line").where("b < id").select(F.col("id").alias("a"), "b").distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, seal, gone: the positions (from 0, ascending) of the lines that go, of each document that loses any."""
    lines = written(line_table(docs), "dedup-lines")
    pairs = overlapping(lines)
    a = lines.select(F.col("id").alias("a"), F.col("lines").alias("lines_a"), F.col("words").alias("words_a"))
    b = lines.select(F.col("id").alias("b"), F.col("lines").alias("lines_b"))
    found = pairs.join(a, "a").join(b, "b").select("a", "lines_a", "words_a", "lines_b").mapInPandas(_aligned, "a bigint, gone array<int>")
    # A document has at most three partners for each of its lines, so what is gathered here is bounded by its own length.
    gone = found.select("a", F.explode("gone").alias("i")).groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_set("i")).alias("gone"))
    return gone.join(lines.select("id", "doc_id", "seal"), "id").select("doc_id", "seal", "gone")


def _judged(docs: DataFrame) -> DataFrame:
    """doc (all columns of docs), gone, text (what is left) for each row of docs."""
    gone = written(repeated_lines(docs), "dedup-gone")
    # Merged whatever its size: what goes grows with the corpus, and no plan should change with it.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("seal"))
    # The lines are a column of their own, so that they are cut once a row and met by position.
    out = keyed.join(gone.hint("merge"), ["doc_id", "seal"], "left").withColumn("l", F.when(F.col("gone").isNotNull(), F.split("doc.text", "\n", -1)))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\\n')")
    return out.select("doc", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(kept).alias("text"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all their columns, without the lines that go; n_chars, where there is one, is that of the new text.

    Null texts and rows with a null doc_id stay as they are. Rows that repeat a doc_id with different texts are documents of their own, in
    the order of their texts' hashes; rows that repeat both stay alike. Documents of which all lines go stay with an empty
    text. Empty docs give an empty result.
    """
    out = _judged(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.size("gone") == 0, F.col("doc.n_chars")).otherwise(F.length("text"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return out.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (positions from 0), text (what is left) for each row of docs; see without_repeats()."""
    out = _judged(docs.select("doc_id", "text"))
    n_lines = F.coalesce(F.size(F.split("doc.text", "\n", -1)), F.lit(0)).cast("bigint")
    return out.select("doc.doc_id", F.when(F.col("doc.text").isNull(), F.lit(0)).otherwise(n_lines).cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_removed"), F.col("gone").alias("removed_lines"), "text")
