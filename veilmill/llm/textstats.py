"""Per-document text statistics as built-in expressions; one row in, one row out, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, word_array

#: Counts that every caller gets, in order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Ratios that models may use; each is defined for empty texts too.
FEATURES = {
    "words": "log2(1 + n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "line_words": "log2(1 + n_words / greatest(n_lines, 1))",
}


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, the COUNTS and the inputs of FEATURES for each row of docs.

    A null text counts as an empty one, all of whose counts are 0. Rows may repeat; each is judged alone.

    n_repeat_words: each 3-word window becomes one long, of a 64-bit hash above the window's position; sorted, equal
    windows are neighbours. This is n log n in the words of one document and needs no shuffle. A document of n words
    keeps 64 - log2(n) bits of hash, at which two unequal windows of one document coincide with probability below
    n^3 / 2^65.
    """
    # Catalyst keeps these projections apart, as each array is used more than once above them.
    rows = docs.select(*keep, text_or_empty().alias("_t"))
    rows = rows.select("*", word_array(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    rows = rows.withColumn("_b", F.length(F.bin(F.size("_w").cast("bigint"))))
    rows = rows.withColumn(
        "_k",
        F.expr("sort_array(transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> shiftleft(xxhash64(x, _w[i + 1], _w[i + 2]), _b) | cast(i as bigint)))"),
    )
    rows = rows.withColumn(
        "_r",
        F.expr("filter(_k, (x, i) -> (i > 0 and shiftrightunsigned(x, _b) = shiftrightunsigned(get(_k, i - 1), _b)) or (i + 1 < size(_k) and shiftrightunsigned(x, _b) = shiftrightunsigned(get(_k, i + 1), _b)))"),
    )
    return rows.select(
        *keep,
        F.expr("cast(size(_w) as bigint)").alias("n_words"),
        F.expr("aggregate(_w, 0L, (s, x) -> s + length(x))").alias("word_chars"),
        F.expr("cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(_r, x -> transform(array(0, 1, 2), d -> (x & (shiftleft(1L, _b) - 1)) + d))))) as bigint)").alias("n_repeat_words"),
        F.expr("cast(size(_l) as bigint)").alias("n_lines"),
        F.expr("cast(size(array_distinct(_w)) as bigint)").alias("n_distinct_words"),
        F.expr("cast(size(filter(_w, x -> length(x) <= 3)) as bigint)").alias("n_stops"),
        F.expr(r"cast(regexp_count(_t, '\\p{Lu}') as bigint)").alias("n_upper"),
        F.expr("cast(length(_t) - length(translate(_t, '0123456789', '')) as bigint)").alias("n_digits"),
        F.expr("cast(length(_t) - length(replace(_t, '!', '')) as bigint)").alias("n_bangs"),
    )


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(F.expr(sql).cast("double").alias(f"f_{name}") for name, sql in FEATURES.items()))
