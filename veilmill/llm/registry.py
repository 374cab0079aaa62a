"""One query per corpus operator, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical_search, line_dedup, mixing, ngram_join, packing, pu_classifier, quality_rules, secrets, spm, suffix_dedup, topk, vector_codes, warc
from .common import load

#: A public SentencePiece model; read where the driver runs, and never copied.
PIECE_MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(load(spark, sf_dir, "documents")).drop("removed")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(load(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages")).drop("url")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(load(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"), 20)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_classifier.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    return spm.encode_decode(load(spark, sf_dir, "documents"), spm.Pieces.load(model))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(load(spark, sf_dir, "embeddings")).drop("label")


def op12_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(load(spark, sf_dir, "documents"), tokenizer)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def _lloyd_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds as a chain of common table expressions, one pair a round."""
    steps = [
        f"""v AS (
            SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), p AS MATERIALIZED (
            SELECT vec_id, label, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS r(part)
        ), c0 AS MATERIALIZED (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}
        )"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
            SELECT p.vec_id, p.label, part, arg_min(entry, (list_dot_product(c.x, c.x) - 2 * list_dot_product(p.x, c.x), entry)) AS entry,
                CAST(min(list_dot_product(c.x, c.x) - 2 * list_dot_product(p.x, c.x)) + any_value(list_dot_product(p.x, p.x)) AS BIGINT) AS error, any_value(p.x) AS x
            FROM p JOIN c{i} AS c USING (part) GROUP BY p.vec_id, p.label, part
        )"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (
            SELECT part, entry, j, floor(sum(x[j]) / count(*)) AS y FROM a{i}, unnest(range(1, len(x) + 1)) AS u(j) GROUP BY part, entry, j
        ), n{i} AS (
            SELECT part, entry, list(y ORDER BY j) AS x FROM m{i} GROUP BY part, entry
        ), c{i + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(n{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN n{i} USING (part, entry)
        )"""
            )
    return f"""
        WITH {", ".join(steps)}, e AS (
            SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
        ), h AS (
            SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h
    """


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_ngram_join": op7_ngram_join,
    "op8_topk_search": op8_topk_search,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_packing": op12_packing,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op1_suffix_dedup": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), s AS (
            SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS g FROM d, unnest(range(0, len(h) // 2 - 99)) AS u(i)
        ), r AS (
            SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
        ), n AS (
            SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), k AS (
            SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n
        ), p AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM k GROUP BY doc_id, span
        ), e AS (
            SELECT doc_id, a, b FROM p UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d
        ), g AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS last FROM e
        )
        SELECT doc_id, CAST(any_value(len(h)) // 2 AS BIGINT) AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, CAST(count(*) - 1 AS BIGINT) AS n_spans,
            sha256(unhex(string_agg(substr(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY a, b))) AS kept_sha256
        FROM g JOIN d USING (doc_id) GROUP BY doc_id
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (
            SELECT *, n >= 100 AND min(page_id) OVER (PARTITION BY d) < page_id AS again, min(page_id) OVER (PARTITION BY d) AS first FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
            CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN first END AS refers_to
        FROM f
    """,
    "op7_ngram_join": """
        WITH RECURSIVE t AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM t, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
        ), c AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
        ), e AS (
            SELECT x, y FROM l UNION ALL SELECT y, x FROM l
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x
        )
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
    """,
    "op8_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
    "op11_vector_codes": _lloyd_sql(),
    "op13_lexical_search": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
        ), s AS (
            SELECT count(*) AS n, sum(len(t)) AS l FROM d WHERE len(t) > 0
        ), f AS (
            SELECT r, doc_id, term, count(*) AS tf, any_value(len(t)) AS n FROM d, unnest(t) AS u(term) GROUP BY r, doc_id, term
        ), g AS (
            SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(s.n) + 2) / (2 * count(*) + 1))) AS w FROM f, s GROUP BY term
        ), i AS (
            SELECT DISTINCT item_id, term FROM benchmark, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS u(term)
        ), p AS (
            SELECT item_id, r, doc_id, CAST(sum(CAST(w AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * f.n * s.n) // s.l)))) AS BIGINT) AS score
            FROM i JOIN f USING (term) JOIN g USING (term), s GROUP BY item_id, r, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
    """,
}
