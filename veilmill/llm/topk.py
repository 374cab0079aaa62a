"""Exact top-k search by multi-resolution segment statistics.

Vectors become whole numbers. In each segment of a vector, the inner product with a query is the product of the means
times the length plus that of the deviations, which the product of the norms of the deviations bounds (Cauchy-Schwarz). So a
vector's distance to the query is at least what its segments' means and deviations say, and its inner product at most
that. The bounds are met coarse to fine:

1. Vectors are dealt into blocks in the order of a curve through their coarse means, and queries likewise. What the means
   and deviations of a block range over bounds every pair of a block of queries and a block of vectors.
2. Each block of queries first meets the block of vectors with the highest bound, which gives each query a k-th best
   score so far. Afterwards vectors are sent only to those blocks of queries whose bound reaches the least of these.
3. Within a pair of blocks, pairs meet one bound per resolution, from few segments to many, and only those that
   could still reach the query's k-th best score get exact products.

Blocks are of bounded size, whatever vectors repeat; each pair of blocks is one task's group, and keeps k rows per query. No
side is broadcast. Only cuts between blocks, one number per block, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors, and queries, in a block; segments of each resolution, coarse to fine; factor before rounding down.
VECTORS, QUERIES, SEGMENTS, FACTOR = 8_192, 4_096, (4, 16), 64
#: Vectors of a block that are looked at together: the first give a k-th best score that the bounds of later ones meet.
STRIPE = 1_024
#: Rounding errors of a bound, as a share of the product of the norms.
SLACK = 1e-9
LONG = 2**63
STATISTICS = "vec_id bigint, x array<double>, width int, query boolean, deal bigint, means array<double>, spread array<double>, norm double"
PART = "query_id bigint, vec_id bigint, score bigint, beyond binary"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x array<double> of whole numbers, of the rows that take part: vec_id and vector not null, no component null or not finite.

    Components over 2.8e306 overflow when they are scaled and count as not finite.
    """
    fine = F.expr(f"vec_id is not null and embedding is not null and forall(embedding, c -> c is not null and not isnan(c) and abs(cast(c as double)) * {FACTOR} < double('infinity'))")
    # floor() of a double is a long; what is too large for it has no fraction.
    whole = f"transform(embedding, c -> if(abs(cast(c as double)) < 1e15D, cast(floor({FACTOR} * cast(c as double)) as double), {FACTOR} * cast(c as double)))"
    return vectors.select("vec_id", "embedding").where(fine).select("vec_id", F.expr(whole).alias("x"))


def _segments(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """mean * sqrt(length) and norm of the deviations of each segment; a dot product of two means their part of the product."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1) if x.shape[1] else []
    with np.errstate(all="ignore"):
        means = [p.mean(axis=1) for p in parts]
        spread = [np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, means, strict=True)]
    scaled = [m * np.sqrt(p.shape[1]) for p, m in zip(parts, means, strict=True)]
    pad = [np.zeros(len(x))] * (segments - len(parts))
    return np.stack([*scaled, *pad], axis=1), np.stack([*spread, *pad], axis=1)


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt((x**2).sum(axis=1))


def _resolutions(x: np.ndarray, slack: float) -> list[np.ndarray]:
    """For each resolution, means, deviations and slack times the norm; a dot product of two, of one with slack 1, bounds theirs."""
    return [np.concatenate([*_segments(x, s), slack * _norms(x)[:, None]], axis=1) for s in SEGMENTS if s < x.shape[1]]


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds means, spread (of the coarsest resolution) and norm."""
    for batch in batches:
        out = {"means": [None] * len(batch), "spread": [None] * len(batch), "norm": np.zeros(len(batch))}
        for width in batch.width.unique():
            at = np.flatnonzero(batch.width.to_numpy() == width)
            x = np.stack(batch.x.iloc[at].to_numpy()).astype(float)
            means, spread = _segments(x, SEGMENTS[0])
            out["norm"][at] = _norms(x)
            for i, m, s in zip(at, means, spread, strict=True):
                out["means"][i], out["spread"][i] = m, s
        yield batch.assign(**out)


def _exact(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Inner products of paired rows in Python's whole numbers."""
    return [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]


def _beyond(score: int) -> bytes | None:
    """Null for a score that a long holds, else bytes in the order of scores."""
    if -LONG <= score < LONG:
        return None
    size = score.bit_length() // 8 + 1
    return (b"\1" + size.to_bytes(4, "big") if score > 0 else b"\0" + (2**32 - 1 - size).to_bytes(4, "big")) + (score % (1 << 8 * size)).to_bytes(size, "big")


def _bound(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num(q @ x.T, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block of vectors for each of one block of queries, by score and then by smaller vec_id.

    floor: a score that each query reaches k times elsewhere; what is below it may be left out.
    """
    order = np.lexsort((ids, -_norms(x)))  # long vectors first: high scores early
    x, ids, floor = x[order], ids[order], floor.astype(float).copy()
    rq, rx = _resolutions(queries, SLACK), _resolutions(x, 1.0)
    # What is below 2**53 for sure is exact in doubles, sums included.
    most_q, most_x = np.abs(queries).max(axis=1, initial=0.0), np.abs(x).max(axis=1, initial=0.0) * max(1, x.shape[1])
    best = pd.DataFrame({"q": np.empty(0, int), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
    for at in range(0, len(x), STRIPE):
        some = slice(at, at + STRIPE)
        rows = np.ones((len(queries), len(x[some])), dtype=bool)
        for sq, sx in zip(rq, rx, strict=True):
            rows &= _bound(sq, sx[some]) >= floor[:, None]
            if not rows.any():
                break
        with np.errstate(all="ignore"):
            sure = bool(most_q.max(initial=0.0) * most_x[some].max(initial=0.0) < 2**53)
        if sure and rows.mean() > 0.25:
            exact = queries @ x[some].T  # most survive: one product of matrices, as exact as the paired ones
            rows &= exact >= floor[:, None]
            i, j = np.nonzero(rows)
            scores = exact[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(rows)
            with np.errstate(all="ignore"):
                fine = most_q[i] * most_x[some][j] < 2**53
            scores = np.zeros(len(i), np.int64 if fine.all() else object)
            scores[fine] = np.einsum("ij,ij->i", queries[i[fine]], x[at + j[fine]]).astype(np.int64)
            if not fine.all():
                scores[~fine] = _exact(queries[i[~fine]], x[at + j[~fine]])
        new = pd.DataFrame({"q": i, "vec_id": ids[at + j], "score": scores})
        new = new[query_ids[i] != ids[at + j]]
        best = pd.concat([best, new]) if len(best) else new
        if best.score.dtype == object:  # whole numbers beyond a long
            rank = sorted(range(len(best)), key=list(zip(best.q, (-s for s in best.score), best.vec_id, strict=True)).__getitem__)
            best = best.iloc[rank]
        else:
            best = best.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        best = best[best.groupby("q").cumcount() < k]
        full = best[best.groupby("q").cumcount() == k - 1]
        reached = np.array([float(max(min(s, 10**300), -(10**300))) for s in full.score], float)
        floor[full.q.to_numpy(int)] = np.maximum(floor[full.q.to_numpy(int)], reached)
    whole = best.score.tolist()
    clipped = np.array([max(min(s, LONG - 1), -LONG) for s in whole], np.int64)
    return pd.DataFrame({"query_id": query_ids[best.q.to_numpy(int)], "vec_id": best.vec_id.to_numpy(np.int64), "score": clipped, "beyond": [_beyond(int(s)) for s in whole]})


def _coded(levels: np.ndarray):
    """Adds code: the place of the coarse means on a curve that interleaves their quantiles' bits, then a hash, so that equal vectors part."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            means = np.stack(batch.means.to_numpy()) if len(batch) else np.zeros((0, SEGMENTS[0]))
            code = np.zeros(len(batch), np.int64)
            step = np.stack([np.searchsorted(levels[s], means[:, s]) for s in range(SEGMENTS[0])], axis=1)
            for bit in range(7, -1, -1):
                for s in range(SEGMENTS[0]):
                    code = code << 1 | (step[:, s] >> bit & 1)
            yield batch.assign(code=code << 30 | batch.deal.to_numpy(np.int64))

    return task


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows with the block, of about size rows, that their code falls into."""
    n = rows.count() // size + 1
    cuts = rows.agg(F.percentile_approx("code", [i / n for i in range(1, n)], F.lit(100 * n)).alias("c")).first()["c"] if n > 1 else []
    # Bisection; struct s is the range [lo, hi] in which the first cut not below the code lies.
    middle = "cast((s.lo + s.hi) div 2 as int)"
    step = f"if(s.lo = s.hi, s, if(cuts[{middle}] < code, named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle})))"
    block = F.expr(f"aggregate(sequence(0, {len(cuts).bit_length()}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> {step}, s -> s.lo)")
    return rows.withColumn("cuts", F.lit(list(cuts) or [0])).withColumn(name, block).drop("cuts")


def _summaries(rows: DataFrame, block: str) -> DataFrame:
    """What the statistics of a block range over, with the block's name in front."""
    each = [f(F.col(c)[s]).alias(f"{block}_{n}{s}") for s in range(SEGMENTS[0]) for n, f, c in (("lo", F.min, "means"), ("hi", F.max, "means"), ("dev", F.max, "spread"))]
    return rows.groupBy(F.col("width").alias(f"{block}_width"), block).agg(F.max("norm").alias(f"{block}_norm"), *each)


def block_pairs(q: DataFrame, x: DataFrame) -> DataFrame:
    """width, qb, xb, bound (on the inner product of any query and any vector of theirs) of the pairs of blocks of a width."""
    met = _summaries(q, "qb").join(_summaries(x, "xb"), F.col("qb_width") == F.col("xb_width"))
    bound = F.lit(SLACK) * F.col("qb_norm") * F.col("xb_norm")
    for s in range(SEGMENTS[0]):
        bound = bound + F.greatest(*(F.col(f"qb_{a}{s}") * F.col(f"xb_{b}{s}") for a in ("lo", "hi") for b in ("lo", "hi"))) + F.col(f"qb_dev{s}") * F.col(f"xb_dev{s}")
    return met.select(F.col("qb_width").alias("width"), "qb", "xb", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))


def _searched(q: DataFrame, x: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, beyond: the k best of each pair of blocks; q has a floor."""
    keys = ["width", "qb", "xb"]
    left = q.select("width", "qb", "vec_id", "floor", "x").join(pairs.select(*keys), ["width", "qb"])
    right = x.select("width", "xb", "vec_id", "x").join(pairs.select(*keys), ["width", "xb"])
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both sides come from one table

    def block(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64), "beyond": np.empty(0, object)})
        return best_of_block(np.stack(a.x.to_numpy()).astype(float), a.vec_id.to_numpy(), a.floor.to_numpy(), np.stack(b.x.to_numpy()).astype(float), b.vec_id.to_numpy(), k)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, PART)


def prepared(vectors: DataFrame, is_query: Column) -> tuple[DataFrame, DataFrame]:
    """The queries and all vectors, with statistics and blocks."""
    rows = whole_numbers(vectors).distinct().withColumn("width", F.size("x")).withColumn("query", F.coalesce(is_query, F.lit(False))).withColumn("deal", F.expr("pmod(xxhash64(vec_id, x), 1 << 30)"))
    rows = written(rows.mapInPandas(_statistics, STATISTICS), "topk-statistics")
    at = [F.percentile_approx(F.col("means")[s], [i / 256 for i in range(1, 256)], F.lit(2_560)).alias(f"l{s}") for s in range(SEGMENTS[0])]
    levels = rows.agg(*at).first()
    levels = np.array([sorted(level or [0.0] * 255) for level in levels])
    rows = written(rows.mapInPandas(_coded(levels), STATISTICS + ", code bigint"), "topk-coded")
    return _blocks(rows.where("query"), QUERIES, "qb"), _blocks(rows, VECTORS, "xb")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k other rows with the highest inner products.

    vectors: vec_id, embedding. is_query picks the queries among the rows that take part (see whole_numbers). Only
    vectors of a query's own length compare with it; empty ones have product 0. Ties go to the smaller vec_id; rows
    that repeat a vec_id are one row if their vectors are equal, and each a candidate of its own otherwise. Products
    beyond a long are ranked exactly and shown as its nearest end. With fewer than k candidates, all are returned;
    without queries, or an empty table, nothing is.
    """
    q, x = prepared(vectors, is_query)
    pairs = written(block_pairs(q, x), "topk-pairs")
    first = written(pairs.groupBy("width", "qb").agg(F.max_by("xb", F.struct("bound", "xb")).alias("xb")), "topk-first")
    found = written(_searched(q.withColumn("floor", F.lit(float("-inf"))), x, first, k), "topk-found")
    reached = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least")).where((F.col("n") == k) & (F.col("least") > -LONG)).select("vec_id", F.col("least").cast("double").alias("least"))
    q = q.join(reached, "vec_id", "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf"))))
    floors = q.groupBy("width", "qb").agg(F.min("floor").alias("floor"))
    rest = pairs.join(first, ["width", "qb", "xb"], "left_anti").join(floors, ["width", "qb"]).where("bound >= floor")
    found = found.unionByName(_searched(q, x, rest, k))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
