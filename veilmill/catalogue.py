"""The engine's registered queries over the driver's tables, each with SQL that must give the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.crypto import hmac_hex, hmac_sql, prefixed, prefixed_sql
from .functions.findall import each, find_all
from .operators import canonical as can
from .operators import detect as det
from .operators import dates, guard, inventory, overlap, persons, policy, reports, rules, vault, walk
from .operators.generate import Generator, shifted_iso
from .plans import pseudonymise as plan
from .plans import seen
from .session import materialise, scratch
from .sources import readers
from .streaming import windows

#: A demonstration key; real masters come from the operator's key store.
KEYS = vault.Keys(b"demonstration master key, not secret")
SCOPE = "project:demo"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a function under its name, with the SQL that checks it."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _whole(*queries: Callable) -> None:
    """Registers each query under its earlier second name, NAME_whole, too."""
    for f in queries:
        QUERIES[f"{f.__name__}_whole"], ORACLES[f"{f.__name__}_whole"] = f, ORACLES[f.__name__]


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re(name: str) -> str:
    return _s(det.BY_NAME[name].pattern)


# Detection


def _values(name: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return det.values(load(spark, sf_dir, table), name, key, text)

    QUERIES[f"detect_{name}_values"] = run
    ORACLES[f"detect_{name}_values"] = f"SELECT {key}, unnest(regexp_extract_all({text}, {_re(name)})) AS value FROM {table}"


for _name in ("email", "ipv4", "card", "assignment", "phone", "sha1", "date"):
    _values(_name)
_values("url", "pages", "page_id", "url")

#: Spans of a few recognisers in SQL: gaps and matches alternate, so a match starts after all gaps and matches before it.
def _spans_sql(*names: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    parts = []
    for n in names:
        r = det.BY_NAME[n]
        parts.append(f"""
            SELECT {key}, '{r.kind}' AS type, m[i] AS value, CAST({r.score} AS DOUBLE) AS score,
                CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS s
            FROM (SELECT {key}, regexp_extract_all({text}, {_re(n)}) AS m, string_split_regex({text}, {_re(n)}) AS g FROM {table}) t, unnest(range(1, len(m) + 1)) AS u(i)
        """)
    return f"SELECT {key}, type, value, s AS start, CAST(s + length(value) AS INTEGER) AS \"end\", score FROM ({' UNION ALL '.join(parts)})"


SOME = ("email", "ipv4", "card", "assignment", "phone", "sha1", "host")


def _spans(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.flatten(F.array(*(find_all("text", det.BY_NAME[n].pattern, det.BY_NAME[n].kind, det.BY_NAME[n].score, det.BY_NAME[n].needs, det.BY_NAME[n].guard) for n in names)))
    return each(docs.withColumn("found", found), "found", "doc_id").select("doc_id", "type", "value", "start", "end", "score")


@query(f"SELECT doc_id, type, value, start, \"end\" FROM ({_spans_sql('email', 'phone')})")
def detect_offsets(spark, sf_dir):
    return _spans(spark, sf_dir, "email", "phone").select("doc_id", "type", "value", "start", "end")


@query(f"SELECT type, lang, count(*) AS n FROM ({_spans_sql(*SOME)}) JOIN documents USING (doc_id) GROUP BY type, lang")
def detect_counts_by_type_lang(spark, sf_dir):
    return _spans(spark, sf_dir, *SOME).join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").groupBy("type", "lang").agg(F.count("*").alias("n"))


@query(f"""
    SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_re('card')})) AS value FROM documents)
    WHERE list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(value[i] AS INTEGER)
        ELSE CAST(value[i] AS INTEGER) * 2 - CASE WHEN CAST(value[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
""")
def luhn_valid_cards(spark, sf_dir):
    return det.values(load(spark, sf_dir, "documents"), "card").where(F.expr("luhn_check(value)"))


@query(f"""
    SELECT doc_id, value, regexp_replace(regexp_replace(regexp_extract(text[1:start], '\\S*$') || value || regexp_extract(text["end" + 1:], '^\\S*'),
        '^[(\\[{{<"''`,;:]+', ''), '[)\\]}}>"''`,;:.!?]+$', '') AS token
    FROM ({_spans_sql('email')}) JOIN documents USING (doc_id)
""")
def token_expand(spark, sf_dir):
    rows = _spans(spark, sf_dir, "email").join(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "value", det.token_around("text", "start", "end").alias("token"))


ALLOW = rules.AllowList.parse([(1, "example.com"), (2, "mail1.example.com"), (3, "re:mail[2-4]\\.example\\.com"), (4, "types:URL re:.*")])
OURS = rules.Inventory.parse([(1, "mail3"), (2, "example")])
_HOSTS = f"SELECT doc_id, unnest(regexp_extract_all(text, {_re('host')})) AS value FROM documents"


@query(f"SELECT doc_id, value, CASE WHEN value IN ('example.com', 'mail1.example.com') THEN 'exact' WHEN regexp_full_match(value, 'mail[2-4]\\.example\\.com') THEN 'mail[2-4]\\.example\\.com' END AS reason FROM ({_HOSTS})")
def public_exact_filter(spark, sf_dir):
    rows = det.values(load(spark, sf_dir, "documents"), "host")
    return rows.select("doc_id", "value", ALLOW.reason(F.lit("HOSTNAME"), F.col("value")).alias("reason"))


@query(f"SELECT doc_id, value FROM ({_HOSTS}) WHERE list_has_any(string_split_regex(lower(value), '[.:/@+_-]+'), ['mail3', 'example'])")
def inventory_segment_filter(spark, sf_dir):
    return det.values(load(spark, sf_dir, "documents"), "host").where(OURS.owns(F.col("value")))


@query(f"""
    SELECT value, string_agg(DISTINCT type, ',' ORDER BY type) AS types, CASE WHEN regexp_full_match(value, '[0-9]+') THEN 'digits' ELSE 'mail host' END AS rule
    FROM ({_spans_sql(*SOME)}) WHERE regexp_full_match(value, '[0-9]+|mail[0-9]\\.example\\.com') GROUP BY value
""")
def public_by_shape(spark, sf_dir):
    return det.public_by_shape(_spans(spark, sf_dir, *SOME), [("digits", "[0-9]+"), ("mail host", r"mail[0-9]\.example\.com")])


@query(f"""
    SELECT type, CASE WHEN type IN ('CREDIT_CARD', 'PASSWORD_CONTEXT') THEN 'secret' WHEN type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER') THEN 'pii' ELSE 'infra' END AS class,
        CASE type WHEN 'PASSWORD_CONTEXT' THEN 1 WHEN 'CREDIT_CARD' THEN 2 WHEN 'COMMIT_SHA' THEN 3 WHEN 'HOSTNAME' THEN 7 WHEN 'IP_ADDRESS' THEN 8 ELSE 6 END AS priority, count(*) AS n
    FROM ({_spans_sql(*SOME)}) GROUP BY type
""")
def span_class_priority(spark, sf_dir):
    rows = _spans(spark, sf_dir, *SOME).groupBy("type").agg(F.count("*").alias("n"))
    return rows.select("type", overlap.class_of(F.col("type")).alias("class"), overlap.priority_of(F.col("type")).alias("priority"), "n")


_SPANS = _spans_sql(*SOME)


@query(f"""
    WITH s AS ({_SPANS}) SELECT a.doc_id, a.type AS type_a, a.start AS start_a, a."end" AS end_a, b.type AS type_b, b.start AS start_b, b."end" AS end_b
    FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end" AND (a.start, a."end", a.type) < (b.start, b."end", b.type)
""")
def overlap_pairs(spark, sf_dir):
    return overlap.overlap_pairs(_spans(spark, sf_dir, *SOME))


@query(f"WITH s AS ({_SPANS}) SELECT doc_id, type, value, start, \"end\" FROM s WHERE EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.start <= s.start AND o.\"end\" >= s.\"end\" AND o.\"end\" - o.start > s.\"end\" - s.start)")
def contained_spans(spark, sf_dir):
    return overlap.contained(_spans(spark, sf_dir, *SOME)).select("doc_id", "type", "value", "start", "end")


@query(f"WITH s AS ({_SPANS}) SELECT doc_id, type, value, start, \"end\" FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.start < s.\"end\" AND s.start < o.\"end\" AND NOT (o.start = s.start AND o.\"end\" = s.\"end\" AND o.type = s.type))")
def uncovered_spans(spark, sf_dir):
    return overlap.uncovered(_spans(spark, sf_dir, *SOME)).select("doc_id", "type", "value", "start", "end")


@query()
def overlap_resolved(spark, sf_dir):
    return each(plan.resolved_spans(load(spark, sf_dir, "documents")), "spans", "doc_id").select("doc_id", "type", "value", "start", "end")


_WORDS = "[A-Z][a-z]+"


@query(f"""
    WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}') AS m, string_split_regex(text, '{_WORDS}') AS g FROM documents),
    w AS (SELECT doc_id, text, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM t, unnest(range(1, len(m) + 1)) AS u(i)),
    l AS (SELECT *, start + length(value) AS e, lag(start + length(value)) OVER (PARTITION BY doc_id ORDER BY start) AS b FROM w),
    k AS (SELECT *, sum(CASE WHEN b IS NULL OR NOT (start - b <= 2 AND regexp_full_match(text[b + 1:start], '[-''’  ]*')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM l)
    SELECT doc_id, CAST(min(start) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end" FROM k GROUP BY doc_id, island
""")
def fragments_merged(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    spans = each(docs.withColumn("spans", find_all("text", _WORDS, "PERSON", 0.5)), "spans", "doc_id")
    return det.merged_fragments(spans, docs).select("doc_id", "start", "end")


# Entities and surrogates

_IPS = f"SELECT DISTINCT unnest(regexp_extract_all(text, {_re('ipv4')})) AS value FROM documents"
_N = "(CAST(string_split(value, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(value, '.')[2] AS BIGINT) * 65536 + CAST(string_split(value, '.')[3] AS BIGINT) * 256 + CAST(string_split(value, '.')[4] AS BIGINT))"
_DOTTED = "concat_ws('.', ({n} // 16777216) % 256, ({n} // 65536) % 256, ({n} // 256) % 256, {n} % 256)"
_PRIVATE = "({n} < 16777216 OR {n} BETWEEN 167772160 AND 184549375 OR {n} BETWEEN 2130706432 AND 2147483647 OR {n} BETWEEN 2851995648 AND 2852061183 OR {n} BETWEEN 2886729728 AND 2887778303 OR {n} BETWEEN 3232235520 AND 3232301055 OR {n} >= 4026531840)".format(n=_N)


def _distinct(spark, sf_dir, name):
    return det.values(load(spark, sf_dir, "documents"), name).select("value").distinct()


@query(f"SELECT value, 'ip:' || {_DOTTED.format(n=_N)} AS key, {_DOTTED.format(n=f'({_N} - {_N} % 256)')} AS subnet FROM ({_IPS})")
def canonical_ip_subnet(spark, sf_dir):
    c = can.canonical(F.lit("IP_ADDRESS"), F.col("value"))
    return _distinct(spark, sf_dir, "ipv4").select("value", c["key"].alias("key"), F.element_at(c["attrs"], "subnet").alias("subnet"))


@query(f"SELECT value, {_PRIVATE} AS private FROM ({_IPS})")
def private_public_ip(spark, sf_dir):
    return _distinct(spark, sf_dir, "ipv4").select("value", can.is_private(can.ipv4_number(F.col("value"))).alias("private"))


@query(f"""
    SELECT DISTINCT value, 'email:' || lower(value) AS key, lower(string_split(value, '@')[1]) AS local, lower(string_split(value, '@')[2]) AS domain,
        CASE WHEN regexp_matches(lower(string_split(value, '@')[1]), '^(svc-|sa-|srv-|service-|system:|bot-|ci-)|(-svc|-sa|-bot|-agent|-runner|-job|-operator)$') THEN 'service' ELSE 'human' END AS actor
    FROM (SELECT unnest(regexp_extract_all(text, {_re('email')})) AS value FROM documents)
""")
def canonical_email(spark, sf_dir):
    c = can.canonical(F.lit("EMAIL_ADDRESS"), F.col("value"))
    at = lambda k: F.element_at(c["attrs"], k).alias(k)
    return _distinct(spark, sf_dir, "email").select("value", c["key"].alias("key"), at("local"), at("domain"), at("actor"))


@query("SELECT DISTINCT h AS host, 'host:' || string_split(h, '.')[1] AS key, CASE WHEN contains(h, '.') THEN regexp_replace(h, '^[^.]*\\.', '') ELSE '' END AS zone FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages)")
def canonical_url_host(spark, sf_dir):
    hosts = load(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host")).distinct()
    c = can.canonical(F.lit("HOSTNAME"), F.col("host"))
    return hosts.select("host", c["key"].alias("key"), F.element_at(c["attrs"], "zone").alias("zone"))


@query(f"SELECT DISTINCT value, substr({hmac_sql(policy.derive(KEYS.master, 'policy'), chr(39) + 'EMAIL_ADDRESS' + chr(39) + ' || chr(31) || value')}, 1, 32) AS print FROM (SELECT unnest(regexp_extract_all(text, {_re('email')})) AS value FROM documents)")
def hmac_fingerprint(spark, sf_dir):
    return _distinct(spark, sf_dir, "email").select("value", policy.fingerprint(KEYS, F.lit("EMAIL_ADDRESS"), F.col("value")).alias("print"))


def _raw_hmac_sql(key: bytes, message: str) -> str:
    return hmac_sql(key, "@").replace("encode(@)", f"({message})")


@query(f"SELECT value, {_raw_hmac_sql(KEYS.index, prefixed_sql(_s(SCOPE), _s('canon:ip'), 'value'))} AS key_idx FROM ({_IPS})")
def vault_key_index(spark, sf_dir):
    return _distinct(spark, sf_dir, "ipv4").select("value", hmac_hex(KEYS.index, prefixed(F.lit(SCOPE), F.lit("canon:ip"), F.col("value"))).alias("key_idx"))


_SALT = KEYS.salt(SCOPE)


def _digest_sql(*parts: str) -> str:
    return hmac_sql(_SALT, " || chr(31) || ".join(parts))


def _number_sql(digest: str) -> str:
    return f"CAST('0x' || substr({digest}, 1, 16) AS UBIGINT)"


@query(f"""
    WITH i AS (SELECT value, {_N} AS n, {_PRIVATE} AS private FROM ({_IPS})),
    d AS (SELECT *, {_number_sql(_digest_sql("'net'", "CAST(n - n % 256 AS VARCHAR)", "'0'"))} AS net, {_number_sql(_digest_sql("'host'", "CAST(n AS VARCHAR)", "'0'"))} AS host FROM i),
    s AS (SELECT value, CASE WHEN private THEN 167772160 + CAST(net % 65536 AS BIGINT) * 256 ELSE 3323068416 + CAST(net % 512 AS BIGINT) * 256 END + CAST(host % 254 AS BIGINT) + 1 AS k FROM d)
    SELECT value, {_DOTTED.format(n='k')} AS surrogate FROM s
""")
def surrogate_ipv4_attempt0(spark, sf_dir):
    v = F.col("value")
    return _distinct(spark, sf_dir, "ipv4").select("value", Generator(_SALT).ipv4(v, can.is_private(can.ipv4_number(v)), F.lit(0)).alias("surrogate"))


@query(f"SELECT DISTINCT value, substr({_digest_sql(chr(39) + 'hex' + chr(39), 'value', chr(39) + '0' + chr(39))}, 1, 40) AS surrogate FROM (SELECT unnest(regexp_extract_all(text, {_re('sha1')})) AS value FROM documents)")
def surrogate_hash(spark, sf_dir):
    return _distinct(spark, sf_dir, "sha1").select("value", Generator(_SALT).hexadecimal(F.col("value"), F.lit(0)).alias("surrogate"))


@query(f"SELECT DISTINCT value, regexp_extract(value, '^([^:=]*[:=]\\s*[\"'']?)', 1) || substr({_digest_sql(chr(39) + 'secret' + chr(39), chr(39) + 'PASSWORD_CONTEXT' + chr(39), 'value')}, 1, 24) || regexp_extract(value, '[\"'']$') AS reference FROM (SELECT unnest(regexp_extract_all(text, {_re('assignment')})) AS value FROM documents)")
def secret_reference(spark, sf_dir):
    return _distinct(spark, sf_dir, "assignment").select("value", Generator(_SALT).secret(F.lit("PASSWORD_CONTEXT"), F.col("value")).alias("reference"))


def _spans_table(spark, sf_dir):
    return each(plan.resolved_spans(load(spark, sf_dir, "documents")), "spans", "doc_id").where(overlap.class_of(F.col("type")) != "public")


@query()
def allocate_entities(spark, sf_dir):
    return vault.allocate(vault.entities(_spans_table(spark, sf_dir)), SCOPE, KEYS).drop("real_enc")


@query("SELECT 'project:demo' AS scope, CAST(0 AS BIGINT) AS surrogate_collisions, CAST(0 AS BIGINT) AS real_collisions")
def collision_count(spark, sf_dir):
    return vault.collisions(vault.allocate(vault.entities(_spans_table(spark, sf_dir)), SCOPE, KEYS))


@query(f"WITH i AS ({_IPS}) SELECT count(*) AS pairs, count(*) AS kept FROM i a JOIN i b ON a.value < b.value AND regexp_replace(a.value, '\\.[0-9]+$', '') = regexp_replace(b.value, '\\.[0-9]+$', '')")
def co_subnet_preserved(spark, sf_dir):
    v = F.col("value")
    net = lambda c: F.regexp_replace(c, r"\.[0-9]+$", "")
    rows = surrogate_ipv4_attempt0(spark, sf_dir).select("value", net(v).alias("net"), net(F.col("surrogate")).alias("new"))
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.net") == F.col("b.net")) & (F.col("a.value") < F.col("b.value")))
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("a.new") == F.col("b.new")).alias("kept"))


@query()
def pseudonymise_documents(spark, sf_dir):
    return plan.pseudonymise(load(spark, sf_dir, "documents"), SCOPE, KEYS)[0]


@query("SELECT doc_id FROM documents WHERE false")
def restore_roundtrip(spark, sf_dir):
    """Documents without secrets that don't come back as they were: none."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = plan.numbered(plan.resolved_spans(docs))
    safe, mapping = plan.pseudonymise(rows, SCOPE, KEYS, searched=True)
    with_secret = each(rows, "spans", "doc_id").where(overlap.class_of(F.col("type")) == "secret").select("doc_id").distinct()
    # Texts meet by their digests, not by themselves.
    back = plan.restore(safe.select("doc_id", "safe_text"), mapping, SCOPE, KEYS).select("doc_id", F.sha2("restored", 256).alias("restored"))
    back = back.join(with_secret, "doc_id", "left_anti").join(docs.select("doc_id", F.sha2("text", 256).alias("text")), "doc_id")
    return back.where("restored != text").select("doc_id")


# Policy

_RULES = [("global", "class", "pii", "reveal"), ("project", "type", "PHONE_NUMBER", "anonymise"), ("session", "type", "EMAIL_ADDRESS", "anonymise"), ("message", "type", "IP_ADDRESS", "reveal"), ("global", "type", "CREDIT_CARD", "reveal")]
_QUESTIONS_SQL = f"SELECT 'q' || event_id AS fingerprint, event_type AS type, CASE WHEN event_type IN ('click', 'view') THEN 'pii' ELSE 'infra' END AS class, 's' || event_id AS surrogate, ts AS seen_at FROM events"


def _policy(spark):
    return spark.createDataFrame(_RULES, "level string, granularity string, key string, decision string")


def _questions(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("q"), F.col("event_id")).alias("fingerprint"), F.col("event_type").alias("type"), F.when(F.col("event_type").isin("click", "view"), "pii").otherwise("infra").alias("class"), F.concat(F.lit("s"), F.col("event_id")).alias("surrogate"), F.col("ts").alias("seen_at"))


@query(f"""
    SELECT DISTINCT type, value, CASE type WHEN 'IP_ADDRESS' THEN 'reveal' ELSE 'anonymise' END AS decision,
        CASE type WHEN 'IP_ADDRESS' THEN 'message/type' WHEN 'CREDIT_CARD' THEN 'secret' WHEN 'PASSWORD_CONTEXT' THEN 'secret' WHEN 'PHONE_NUMBER' THEN 'project/type' WHEN 'EMAIL_ADDRESS' THEN 'session/type' ELSE 'default' END AS source
    FROM ({_SPANS})
""")
def policy_decide(spark, sf_dir):
    return policy.decide(_spans(spark, sf_dir, *SOME).select("type", "value").distinct(), _policy(spark), KEYS)


@query(f"SELECT fingerprint, type FROM ({_QUESTIONS_SQL}) WHERE class <> 'pii'")
def pending_questions(spark, sf_dir):
    q = _questions(spark, sf_dir)
    return policy.pending(q.unionByName(q), _policy(spark)).select("fingerprint", "type")


@query(f"""
    WITH q AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY seen_at, fingerprint) AS r FROM ({_QUESTIONS_SQL}))
    SELECT type, count(*) AS n, string_agg(CASE WHEN r <= 3 THEN surrogate END, ', ' ORDER BY r) AS preview FROM q GROUP BY type
""")
def questions_by_type(spark, sf_dir):
    return policy.questions_by_type(_questions(spark, sf_dir))


@query(f"SELECT fingerprint, type, class, count(*) OVER (PARTITION BY fingerprint) AS by_value, count(*) OVER (PARTITION BY type) AS by_type, count(*) OVER (PARTITION BY class) AS by_class FROM ({_QUESTIONS_SQL})")
def decision_coverage(spark, sf_dir):
    return policy.coverage(_questions(spark, sf_dir))


@query(f"SELECT class, type, count(*) AS n FROM ({_QUESTIONS_SQL}) GROUP BY ROLLUP (class, type)")
def questions_rollup(spark, sf_dir):
    """Extension: open questions by class and type with subtotals."""
    return _questions(spark, sf_dir).rollup("class", "type").agg(F.count("*").alias("n"))


_whole(pending_questions, questions_by_type, decision_coverage, questions_rollup)


_SETTINGS = [("default", "mode", "auto"), ("global", "mode", "ask"), ("session", "mode", "deferred"), ("default", "dates", "free"), ("env", "dates", "same side"), ("default", "paths", "mask")]


@query("SELECT * FROM (VALUES ('mode', 'deferred', 'session'), ('dates', 'same side', 'env'), ('paths', 'mask', 'default')) t(name, value, level)")
def settings_resolved(spark, sf_dir):
    return policy.settings(spark.createDataFrame(_SETTINGS, "level string, name string, value string"))


# Dates

_SHIFT = 437


@query(f"SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + {_SHIFT}, '%Y-%m-%d') AS shifted FROM orders")
def date_shift_iso(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return rows.select("o_orderkey", shifted_iso(F.col("d"), F.lit(_SHIFT)).alias("shifted"))


@query("SELECT o_custkey, CAST(max(CAST(o_orderdate AS DATE)) - min(CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders GROUP BY o_custkey")
def interval_preserved(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_custkey", Generator(_SALT).date(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(0)).cast("date").alias("d"))
    return rows.groupBy("o_custkey").agg(F.datediff(F.max("d"), F.min("d")).alias("days"))


# Reports, on events as flows

_FLOWS = "SELECT CASE WHEN event_id % 7 = 0 OR user_id % 40 = 3 THEN 'connect' WHEN event_id % 31 = 0 THEN 'error' ELSE 'http' END AS kind, 'H' || (user_id % 40) || '.example.com' AS host, CAST(443 + event_id % 3 AS INTEGER) AS port, '/' || event_type AS path, event_id % 1000 AS bytes_out, event_id % 77 AS bytes_in FROM events"


def _flows(spark, sf_dir):
    """Every event as a flow; all those of one host are tunnels."""
    e = load(spark, sf_dir, "events")
    kind = F.expr("case when event_id % 7 = 0 or user_id % 40 = 3 then 'connect' when event_id % 31 = 0 then 'error' else 'http' end")
    return e.select(kind.alias("kind"), F.expr("concat('H', user_id % 40, '.example.com')").alias("host"), F.expr("cast(443 + event_id % 3 as int)").alias("port"), F.concat(F.lit("/"), "event_type").alias("path"), F.expr("event_id % 1000").alias("bytes_out"), F.expr("event_id % 77").alias("bytes_in"))


_BY_HOST = f"""
    SELECT lower(host) AS host, count(*) FILTER (kind = 'http') AS n_http, count(*) FILTER (kind = 'connect') AS n_connect, count(*) FILTER (kind = 'error') AS n_error,
        CAST(coalesce(sum(bytes_out) FILTER (kind = 'http'), 0) AS BIGINT) AS bytes_out, CAST(coalesce(sum(bytes_in) FILTER (kind = 'http'), 0) AS BIGINT) AS bytes_in,
        string_agg(DISTINCT CAST(port AS VARCHAR), ',' ORDER BY CAST(port AS VARCHAR)) AS ports
    FROM ({_FLOWS}) GROUP BY 1
"""


@query(_BY_HOST)
def egress_by_host(spark, sf_dir):
    return reports.by_host(_flows(spark, sf_dir))


@query(f"SELECT CAST(coalesce(sum(bytes_out) FILTER (lower(host) = 'h1.example.com'), 0) AS BIGINT) AS own, CAST(sum(bytes_out) AS BIGINT) AS total, coalesce(coalesce(sum(bytes_out) FILTER (lower(host) = 'h1.example.com'), 0) / CAST(nullif(sum(bytes_out), 0) AS DOUBLE), 0) AS ratio FROM ({_FLOWS}) WHERE kind = 'http'")
def egress_ratio(spark, sf_dir):
    return reports.byte_ratio(_flows(spark, sf_dir), "h1.example.com")


@query(f"SELECT host, n_connect, n_error FROM ({_BY_HOST}) WHERE n_http = 0 AND n_connect + n_error > 0")
def connect_only_hosts(spark, sf_dir):
    return reports.connect_only(_flows(spark, sf_dir))


@query(f"SELECT DISTINCT lower(host) AS host FROM ({_FLOWS}) WHERE lower(host) NOT IN ('h1.example.com', 'h2.example.com') AND NOT regexp_full_match(lower(host), '.*\\.h9\\.example\\.com')")
def unjustified_hosts(spark, sf_dir):
    return reports.unjustified(_flows(spark, sf_dir), spark.createDataFrame([("H1.example.com",), ("h2.example.com",), ("*.h9.example.com",)], "pattern string"))


@query(f"SELECT lower(host) AS host, path, count(*) AS n FROM ({_FLOWS}) WHERE kind = 'http' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 40")
def egress_paths(spark, sf_dir):
    return reports.paths(_flows(spark, sf_dir))


_whole(egress_by_host, egress_ratio, connect_only_hosts, unjustified_hosts, egress_paths)


@query("SELECT DISTINCT h AS host, CASE WHEN h = 'site1.example.com' THEN 'tunnel' WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'inspect' ELSE 'refuse' END AS verdict FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages)")
def forward_verdict(spark, sf_dir):
    hosts = load(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"))
    table = rules.destinations(spark, [(1, "inspect example.com"), (2, "tunnel site1.example.com")])
    return rules.verdicts(hosts, table)


_URL = r"^([a-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


@query(f"SELECT page_id, regexp_extract(url, '{_URL}', 1) AS scheme, regexp_extract(url, '{_URL}', 2) AS authority, regexp_extract(url, '{_URL}', 3) AS path, regexp_extract(url, '{_URL}', 4) AS query FROM pages")
def url_parts(spark, sf_dir):
    part = lambda i, n: F.regexp_extract("url", _URL, i).alias(n)
    return load(spark, sf_dir, "pages").select("page_id", part(1, "scheme"), part(2, "authority"), part(3, "path"), part(4, "query"))


@query(f"SELECT name, count(*) AS n FROM (SELECT string_split(unnest(string_split(regexp_extract(url, '{_URL}', 4), '&')), '=')[1] AS name FROM pages) WHERE name <> '' GROUP BY name")
def query_param_names(spark, sf_dir):
    names = F.explode(F.split(F.regexp_extract("url", _URL, 4), "&"))
    return load(spark, sf_dir, "pages").select(names.alias("p")).select(F.substring_index("p", "=", 1).alias("name")).where("name != ''").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY field ORDER BY n DESC, field LIMIT 40")
def json_field_histogram(spark, sf_dir):
    return reports.field_histogram(load(spark, sf_dir, "events"), "props")


@query("""
    WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, n, min(value) AS least, quantile_cont(value, 0.5) AS p50, max(value) FILTER (i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95, max(value) AS most FROM e GROUP BY event_type, n
""")
def latency_percentiles(spark, sf_dir):
    return reports.latency(load(spark, sf_dir, "events"), "value", "event_type")


def _masked(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", det.BY_NAME["email"].pattern, "x@y.z").alias("output"))


@query(f"SELECT doc_id AS id FROM documents WHERE regexp_matches(text, {_re('email')})")
def variance_runs(spark, sf_dir):
    plain = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("output"))
    return reports.variance(plain, _masked(spark, sf_dir))


@query(f"""
    WITH s AS ({_spans_sql('email', 'phone')}), o AS (SELECT doc_id, regexp_replace(text, {_re('email')}, 'x@y.z', 'g') AS output FROM documents)
    SELECT type, count(*) AS expected, count(*) FILTER (NOT contains(output, value)) AS found FROM s JOIN o USING (doc_id) GROUP BY type
""")
def recall_by_type(spark, sf_dir):
    truth = _spans(spark, sf_dir, "email", "phone").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("type", "value")).alias("entities"))
    return reports.recall_by_type(truth, _masked(spark, sf_dir))


@query(f"""
    WITH s AS ({_spans_sql('email', 'phone')}), o AS (SELECT doc_id, regexp_replace(text, {_re('email')}, 'x@y.z', 'g') AS output FROM documents)
    SELECT doc_id AS id, count(*) FILTER (type = 'EMAIL_ADDRESS' AND contains(output, value)) AS n_leaks, count(*) FILTER (type = 'PHONE_NUMBER' AND NOT contains(output, value)) AS n_lost FROM s JOIN o USING (doc_id) GROUP BY doc_id
""")
def leak_check(spark, sf_dir):
    pick = lambda k: F.collect_list(F.when(F.col("type") == k, F.col("value")))
    truth = _spans(spark, sf_dir, "email", "phone").groupBy(F.col("doc_id").alias("id")).agg(pick("EMAIL_ADDRESS").alias("must_not_leak"), pick("PHONE_NUMBER").alias("must_stay_clear"))
    return reports.leaks(truth, _masked(spark, sf_dir))


@query("""
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS groupe, count(*) AS n, count(*) FILTER ((quality = 1) = (toxic = 1)) AS "right", count(*) FILTER (quality = 1 AND toxic = 0) AS leaked, count(*) FILTER (quality = 0 AND toxic = 1) AS "over" FROM labels GROUP BY 1
""")
def bench_confusion(spark, sf_dir):
    name = lambda c: F.when(F.col(c) == 1, "sensible").otherwise("public")
    rows = load(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("groupe"), name("quality").alias("expected"), name("toxic").alias("judged"))
    return reports.confusion(rows)


@query("SELECT conv_id, turn, substr(sha256(text), 1, 16) AS digest FROM conversations")
def audit_digest(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", reports.digest(F.col("text")).alias("digest"))


_COMMANDS = (
    "ls -la", "kubectl get secret db -o yaml", "kubectl exec -it web -- sh", "cat ~/.ssh/config", "cat README.md", "terraform state pull", "gh api /user", "gh auth token", "docker inspect web",
    "git remote -v", "git status", "crontab -l", "cat /proc/self/environ", "helm get values web", "LD_PRELOAD=/tmp/x.so ls", "cat .bash_history", "strace -p 12", "make test", "cat deploy/secrets.yaml", "openssl x509 -in server.pem",
    "cat .env", "cat .env.example", "cat .env; echo .env.example", "cat id_rsa.pub", "grep process.env src/a.js", "gcloud auth print-access-token", "kubectl get pods,secrets", "ps auxe", "git config --list", ". /tmp/x.sh", "terraform output", "docker run -v ~/.ssh:/x img",
    "aws sso login", "security find-generic-password -w", "systemctl show-environment", "echo $HISTFILE", "cp service-account-x.json /tmp", "cat prod.env|xxd",
)


@query(
    "WITH t AS (SELECT conv_id, turn, command, regexp_replace(command, " + _s(guard.PUBLIC) + ", '', 'g') AS rest FROM (SELECT conv_id, turn, concat(c, ' ', text) AS command FROM conversations JOIN (VALUES " + ", ".join(f"({i}, {_s(c)})" for i, c in enumerate(_COMMANDS)) + f") AS v(i, c) ON (conv_id + turn) % {len(_COMMANDS)} = i)) SELECT conv_id, turn, "
    + guard.reason_sql("rest", _s)
    + " AS reason FROM t"
)
def guard_pattern_reason(spark, sf_dir):
    """Each turn behind a command of a list, by turns."""
    commands = F.array(*map(F.lit, _COMMANDS))
    rows = load(spark, sf_dir, "conversations").withColumn("command", F.concat(F.get(commands, ((F.col("conv_id") + F.col("turn")) % len(_COMMANDS)).cast("int")), F.lit(" "), F.coalesce("text", F.lit(""))))
    return rows.select("conv_id", "turn", guard.pattern_reason(F.col("command")).alias("reason"))


@query()
def guard_screen(spark, sf_dir):
    """Every turn as a shell command; prose passes or fails by the same rules."""
    c = load(spark, sf_dir, "conversations")
    events = c.select("conv_id", "turn", F.lit("Bash").alias("tool_name"), F.col("conv_id").cast("string").alias("session_id"), F.to_json(F.struct(F.col("text").alias("command"))).alias("tool_input"))
    return guard.screen(events).select("conv_id", "turn", "decision", "reason")


# Nested JSON, sources and streams


@query("SELECT conv_id, turn, '/content' AS path, text FROM conversations WHERE text IS NOT NULL")
def json_leaves(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    bodies = c.select(F.struct("conv_id", "turn").alias("body_id"), F.to_json(F.struct(F.col("role"), F.col("text").alias("content"))).alias("body"))
    return walk.exploded(bodies).select("body_id.conv_id", "body_id.turn", "path", "text")


@query("SELECT conv_id, turn, text FROM conversations WHERE octet_length(encode(text)) >= 12")
def base64_readable(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("octet_length(text) >= 12")
    return c.select("conv_id", "turn", walk.readable_base64(F.base64(F.col("text").cast("binary"))).alias("text"))


@query("SELECT conv_id, turn, text, 'event' AS status FROM conversations")
def sse_blocks(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    block = readers.encoded(F.lit("turn"), F.to_json(F.struct("text", "turn")))
    stream = c.groupBy("conv_id").agg(F.concat(F.lit(": hello\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), ""), F.lit("data: [DONE]\n\n")).alias("stream"))
    rows = stream.select("conv_id", F.explode(readers.blocks(F.col("stream"))).alias("b")).select("conv_id", readers.event(F.col("b")).alias("e")).where("e.status != 'none'")
    return rows.select("conv_id", F.get_json_object("e.data", "$.turn").cast("bigint").alias("turn"), F.get_json_object("e.data", "$.text").alias("text"), "e.status")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return windows.tumbling_counts(load(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
    WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM l)
    SELECT user_id, count(*) AS n, min(ts) AS start FROM s GROUP BY user_id, session
""")
def session_windows(spark, sf_dir):
    return windows.sessions(load(spark, sf_dir, "events")).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))


# Bodies, dates, predicates and reports, each against SQL over the same tables


@query("SELECT conv_id, turn, '/messages/0/content/0/text' AS path, text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT conv_id, turn, '/metadata/' || role, role FROM conversations UNION ALL SELECT conv_id, turn, '/metadata#' || role, role FROM conversations")
def json_nested_leaves(spark, sf_dir):
    """Requests with protocol fields, blocks and a free map, whose keys are leaves too."""
    c = load(spark, sf_dir, "conversations")
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    message = F.struct(F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise("user").alias("role"), F.array(block).alias("content"))
    request = F.struct(F.lit("model-1").alias("model"), F.array(message).alias("messages"), F.create_map("role", "role").alias("metadata"))
    return walk.exploded(c.select(F.struct("conv_id", "turn").alias("body_id"), F.to_json(request).alias("body"))).select("body_id.conv_id", "body_id.turn", "path", "text")


@query("SELECT conv_id, turn, text FROM conversations")
def json_bodies_put_back(spark, sf_dir):
    """Every text in capitals by way of leaves and back, then read from the body in lower case again: nothing but the leaf has changed."""
    c = load(spark, sf_dir, "conversations").withColumn("_id", F.concat_ws("-", "conv_id", "turn"))
    bodies = c.select(F.col("_id").alias("body_id"), "conv_id", "turn", "text", F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("body"))
    changed = walk.exploded(bodies).select("body_id", "path", F.concat(F.lit("<"), "text", F.lit(">")).alias("text"))
    back = walk.put_back(bodies, changed).withColumn("new", F.get_json_object("body", "$.content"))
    return back.select("conv_id", "turn", F.when(F.col("new") == F.concat(F.lit("<"), "text", F.lit(">")), F.col("text")).alias("text"))


@query(f"SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + {_SHIFT}, '%d/%m/%Y') AS numeric, 'from ' || strftime(CAST(o_orderdate AS DATE) + {_SHIFT}, '%Y-%m-%d') || ' to ' || strftime(CAST(o_orderdate AS DATE) + {_SHIFT}, '%Y/%m/%d') AS inside FROM orders")
def date_shift_in_hands(spark, sf_dir):
    day = lambda pattern: F.date_format("o_orderdate", pattern)
    rows = load(spark, sf_dir, "orders").select("o_orderkey", day("dd/MM/yyyy").alias("a"), F.concat(F.lit("from "), day("yyyy-MM-dd"), F.lit(" to "), day("yyyy/MM/dd")).alias("b"))
    return rows.select("o_orderkey", dates.shifted(F.col("a"), F.lit(_SHIFT)).alias("numeric"), dates.shifted(F.col("b"), F.lit(_SHIFT)).alias("inside"))


@query("SELECT o_orderkey, 1 AS \"start\", 11 AS \"end\", strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders UNION ALL SELECT o_orderkey, 15, 25, strftime(o_orderdate, '%Y/%m/%d') FROM orders")
def dates_in_texts(spark, sf_dir):
    text = F.concat(F.lit("("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("), ["), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("] 12/34"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.explode(dates.dated(text)).alias("d"))
    return rows.select("o_orderkey", "d.start", "d.end", "d.value")


@query(f"SELECT o_orderkey, strftime(CAST('0001-01-01' AS DATE) + CAST(((CAST(o_orderdate AS DATE) - CAST('0001-01-01' AS DATE)) + {_SHIFT}) % (CAST('2000-06-15' AS DATE) - CAST('0001-01-01' AS DATE) + 1) AS INTEGER), '%Y-%m-%d') AS shifted FROM orders WHERE CAST(o_orderdate AS DATE) <= CAST('2000-06-15' AS DATE)")
def date_same_side(spark, sf_dir):
    """Dates up to a given today rotate among themselves."""
    rows = load(spark, sf_dir, "orders").where("cast(o_orderdate as date) <= date'2000-06-15'").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return rows.select("o_orderkey", dates.shifted(F.col("d"), F.lit(_SHIFT), "2000-06-15").alias("shifted"))


@query("SELECT doc_id FROM documents WHERE false")
def pseudonymised_leaks(spark, sf_dir):
    """Documents in whose pseudonymised text one of their own addresses, mails, phones or hosts still stands: none."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    safe, _ = plan.pseudonymise(docs, SCOPE, KEYS)
    found = _spans(spark, sf_dir, "email", "ipv4", "phone").select("doc_id", "value").distinct()
    return safe.join(found, "doc_id").where(F.contains("safe_text", F.col("value"))).select("doc_id").distinct()


@query(f"SELECT count(DISTINCT regexp_replace(value, '\\.[0-9]+$', '')) AS real_nets, count(DISTINCT regexp_replace(value, '\\.[0-9]+$', '')) AS new_nets, count(DISTINCT regexp_replace(value, '\\.[0-9]+$', '')) AS pairs, count(DISTINCT value) AS surrogates FROM ({_IPS})")
def subnets_allocated(spark, sf_dir):
    """Networks of the allocated mapping: as many new ones as real ones, and each real one with one new one."""
    ips = det.values(load(spark, sf_dir, "documents"), "ipv4").select(F.lit("IP_ADDRESS").alias("type"), "value").distinct()
    net = lambda c: F.regexp_replace(c, r"\.[0-9]+$", "")
    view = vault.view(vault.allocate(vault.entities(ips), SCOPE, KEYS), SCOPE, KEYS).select(net("real").alias("a"), net("surrogate").alias("b"), "surrogate")
    return view.agg(F.countDistinct("a").alias("real_nets"), F.countDistinct("b").alias("new_nets"), F.countDistinct("a", "b").alias("pairs"), F.countDistinct("surrogate").alias("surrogates"))


@query(
    f"WITH t AS (SELECT conv_id, turn, regexp_replace(text, {_s(guard.PUBLIC)}, '', 'g') AS rest FROM conversations) SELECT conv_id, turn, "
    + guard.reason_sql("rest", _s)
    + " AS reason FROM t"
)
def guard_patterns_on_texts(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", guard.pattern_reason(F.col("text")).alias("reason"))


@query("SELECT event_type AS key, arg_max(CASE event_id % 3 WHEN 0 THEN 'reveal' WHEN 1 THEN 'anonymise' END, event_id) FILTER (true) AS decision FROM (SELECT * FROM events) GROUP BY event_type HAVING max(event_id) % 3 <> 2")
def message_answers(spark, sf_dir):
    """The last answer for each key; one that takes an answer back leaves none."""
    e = load(spark, sf_dir, "events")
    answers = e.select(F.col("event_id").alias("seq"), F.lit("type").alias("granularity"), F.col("event_type").alias("key"), F.expr("case event_id % 3 when 0 then 'reveal' when 1 then 'anonymise' end").alias("decision"))
    return policy.answered(answers).select("key", "decision")


@query("SELECT '/' || event_type AS path, count(*) AS n, CAST(sum(event_id % 1000) AS BIGINT) AS bytes FROM events GROUP BY event_type")
def path_counters(spark, sf_dir):
    return reports.path_counters(_flows(spark, sf_dir).withColumn("path", F.concat("path", F.lit("?q="), "host")))


@query("SELECT 2 * count(*) AS calls, 2 * count(*) - count(DISTINCT text) AS hits, CAST(2 * sum(doc_id % 5) AS BIGINT) AS detected, CAST(2 * sum(doc_id % 3) AS BIGINT) AS substituted FROM documents WHERE text IS NOT NULL")
def pipeline_counters(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where("text is not null").select("text", F.expr("doc_id % 5").alias("n_spans"), F.expr("doc_id % 3").alias("n_entities"))
    return reports.pipeline_counters(d.unionByName(d))


@query("SELECT v AS value, CAST(sum((length(html) - length(replace(html, v, ''))) / length(v)) AS BIGINT) AS n FROM pages, (VALUES ('example'), ('</p>'), ('href'), ('UTF'), ('no such value')) t(v) GROUP BY v")
def value_occurrences(spark, sf_dir):
    values = spark.createDataFrame([(v,) for v in ("example", "</p>", "href", "UTF", "no such value")], "value string")
    return reports.occurrences(load(spark, sf_dir, "pages").select(F.col("html").alias("body")), values)


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flattened(spark, sf_dir):
    return walk.flattened(load(spark, sf_dir, "events"), "props", "event_id")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(^|\\.)example\\.org$') AS open, false AS local FROM pages")
def host_predicates(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    host = rules.url_host(F.col("url"))
    return pages.select("page_id", host.alias("host"), rules.is_open_host(host, ["example.org"]).alias("open"), rules.is_local(F.col("url")).alias("local"))


@query("SELECT DISTINCT host, '*.example.*' AS glob FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages) WHERE regexp_matches(host, '^.*\\.example\\..*$')")
def hosts_justified(spark, sf_dir):
    hosts = load(spark, sf_dir, "pages").select(rules.url_host(F.col("url")).alias("host")).distinct()
    return rules.justified(hosts, ["nowhere.test", "*.example.*"])


@query("SELECT event_id, length(CAST(event_id * 7919 AS VARCHAR)) <= 5 AND event_id * 7919 < 65536 AS port FROM events")
def ports(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", rules.is_port((F.col("event_id") * 7919).cast("string")).alias("port"))


@query(f"SELECT doc_id, value, CASE WHEN value IN ('example.com', 'mail1.example.com') THEN 'exact' WHEN regexp_full_match(value, 'mail[2-4]\\.example\\.com') THEN 'mail[2-4]\\.example\\.com' END AS reason FROM ({_HOSTS})")
def public_by_join(spark, sf_dir):
    """Exact entries of the allow list met by a join instead of a chain of conditions."""
    rows = det.values(load(spark, sf_dir, "documents"), "host").withColumn("kind", F.lit("HOSTNAME"))
    return ALLOW.with_reason(rows, "kind", "value").select("doc_id", "value", "reason")


@query("WITH m AS (SELECT quantile_disc(event_id, 0.5) AS middle FROM events) SELECT CASE WHEN event_id <= middle THEN 'first' ELSE 'second' END AS half, count(*) AS n, quantile_cont(value, 0.5) AS median FROM events, m GROUP BY 1")
def latency_halves(spark, sf_dir):
    return reports.latency_halves(load(spark, sf_dir, "events"), "value", "event_id")


@query(f"""
    WITH s AS ({_spans_sql('email', 'phone')})
    SELECT doc_id, type, trim(value, '.,;:!?()[]{{}}<>"'' ') AS value, CAST(start + 1 + length(value) - length(ltrim(value, '.,;:!?()[]{{}}<>"'' ')) - 1 AS INTEGER) AS start FROM s
""")
def spans_trimmed(spark, sf_dir):
    """Spans, each with punctuation around it, trimmed to what they were."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = F.flatten(F.array(*(find_all("text", det.BY_NAME[n].pattern, det.BY_NAME[n].kind, det.BY_NAME[n].score, det.BY_NAME[n].needs, det.BY_NAME[n].guard) for n in ("email", "phone"))))
    wide = F.transform(spans, lambda s: s.withField("value", F.concat(F.lit("(<"), s["value"], F.lit("!)"))).withField("start", s["start"] - 2).withField("end", s["end"] + 2))
    return docs.select("doc_id", wide.alias("spans")).select("doc_id", F.explode(det.trimmed("spans")).alias("s")).select("doc_id", "s.type", "s.value", "s.start")


# Labels of any number: hosts of pages, what they end in, and their own first names, marked in documents where no mail address lies.

_LABELS = "SELECT DISTINCT lower(l) AS label FROM (SELECT h AS l FROM hosts UNION ALL SELECT regexp_extract(h, '[^.]+\\.[^.]+$') FROM hosts UNION ALL SELECT regexp_extract(h, '([^.]+)\\.[^.]+\\.[^.]+$', 1) FROM hosts)"


@query(f"""
    WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages), labels AS ({_LABELS}),
    t AS (SELECT doc_id, regexp_extract_all(text, {_s(inventory.TOKEN)}) AS m, string_split_regex(text, {_s(inventory.TOKEN)}) AS g FROM documents),
    w AS (SELECT doc_id, m[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM t, unnest(range(1, len(m) + 1)) AS u(i)),
    p AS (SELECT value, list_filter(string_split_regex(lower(value), {_s(inventory.BREAK)}), lambda x: x <> '') AS p FROM (SELECT DISTINCT value FROM w)),
    r AS (SELECT value, array_to_string(p[a:b], ' ') AS gram FROM p, unnest(range(1, len(p) + 1)) AS x(a), unnest(range(1, len(p) + 1)) AS y(b) WHERE a <= b),
    o AS (SELECT DISTINCT value FROM r JOIN (SELECT DISTINCT array_to_string(list_filter(string_split_regex(label, {_s(inventory.BREAK)}), lambda x: x <> ''), ' ') AS gram FROM labels) USING (gram) WHERE gram <> ''),
    e AS ({_spans_sql('email')})
    SELECT doc_id, value, start, CAST(start + length(value) AS INTEGER) AS "end" FROM w JOIN o USING (value)
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = w.doc_id AND e.start < w.start + length(w.value) AND w.start < e."end")
""")
def inventory_labels_marked(spark, sf_dir):
    hosts = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("h"))
    labels = hosts.select(F.explode(F.array("h", F.regexp_extract("h", r"[^.]+\.[^.]+$", 0), F.regexp_extract("h", r"([^.]+)\.[^.]+\.[^.]+$", 1))).alias("label"))
    email = det.BY_NAME["email"]
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", find_all("text", email.pattern, email.kind, email.score, needs=email.needs))
    docs = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    return inventory.marked(docs, labels, spans="spans").join(docs.select("_row", "doc_id"), "_row").select("doc_id", "value", "start", "end")


_FIRSTS = "SELECT DISTINCT substr(text, 1, k) AS value FROM conversations, (VALUES (1), (2), (3), (4), (9)) t(k)"


@query(f"SELECT value, CAST(coalesce(sum((length(text) - length(replace(text, value, ''))) / length(value)), 0) AS BIGINT) AS n FROM ({_FIRSTS}) v LEFT JOIN documents ON contains(text, value) WHERE value <> '' GROUP BY value")
def any_value_occurrences(spark, sf_dir):
    """What turns begin with, one to nine characters of it, counted in all documents."""
    values = load(spark, sf_dir, "conversations").select(F.explode(F.array(*(F.substring("text", 1, k) for k in (1, 2, 3, 4, 9)))).alias("value"))
    return reports.occurrences(load(spark, sf_dir, "documents").select(F.col("text").alias("body")), values)


# What the corpus itself tells: persons confirmed once, texts seen before


_TOKENS, _NAME = f"{persons.CHARS}+", persons.NAME_WORD


def _signed_sql() -> str:
    """Documents, each with the first two capitalised words of its text as a signature behind it."""
    return f"""
        SELECT doc_id, body, w, CASE WHEN len(w) = 2 THEN body || chr(10) || 'Dr. ' || w[1] || ' ' || w[2] ELSE body END AS text
        FROM (SELECT doc_id, coalesce(text, '') AS body, list_filter(regexp_extract_all(coalesce(text, ''), {_s(_TOKENS)}), lambda x: regexp_full_match(x, {_s(_NAME)}))[1:2] AS w FROM documents)
    """


def _windows_sql() -> str:
    """Runs of 1 to 4 capitalised words of the table signed."""
    piece = _s(rf"{_TOKENS}(?: {persons.PARTICLES}?)?")
    linked = lambda j: f"(v{j - 1} LIKE '% ' AND e{j - 1} = s{j} AND ok{j})"
    leads = ", ".join(f"lead({c}, {j}) OVER d AS {a}{j}" for j in (1, 2, 3) for c, a in (("value", "v"), ("word", "w"), ("start", "s"), ("e", "e"), ("ok", "ok")))
    kinds = [f"SELECT doc_id, s0 AS start, {' || '.join([*(f'v{j}' for j in range(k)), f'w{k}'])} AS value, w0 AS first, w{k} AS last, {k + 1} AS k FROM q WHERE {' AND '.join(['ok0', *map(linked, range(1, k + 1))])}" for k in range(4)]
    return f"""
        m AS (SELECT doc_id, regexp_extract_all(text, {piece}) AS m, string_split_regex(text, {piece}) AS g FROM signed),
        p AS (SELECT doc_id, i, m[i] AS value, split_part(m[i], ' ', 1) AS word, regexp_full_match(split_part(m[i], ' ', 1), {_s(_NAME)}) AS ok,
            CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM m, unnest(range(1, len(m) + 1)) AS u(i)),
        r AS (SELECT *, CAST(start + length(value) AS INTEGER) AS e FROM p),
        q AS (SELECT doc_id, value AS v0, word AS w0, start AS s0, e AS e0, ok AS ok0, {leads} FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        runs AS ({' UNION ALL '.join(kinds)})
    """


@query(f"""
    WITH signed AS ({_signed_sql()}), {_windows_sql()},
    names AS (SELECT DISTINCT w[1] AS first, w[2] AS last, w[1] || ' ' || w[2] AS name FROM signed WHERE len(w) = 2),
    spelt AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {_s(_TOKENS)})) AS w FROM signed) GROUP BY w),
    proper AS (SELECT a.word FROM (SELECT first AS word FROM names UNION SELECT last FROM names) a JOIN spelt ON lower(spelt.w) = lower(a.word) GROUP BY a.word
        HAVING sum(CASE WHEN regexp_matches(spelt.w, '^\\p{{Lu}}') THEN n ELSE 0 END) * 100 >= sum(n) * {persons.PROPER}),
    firsts AS (SELECT DISTINCT first FROM names WHERE first IN (SELECT word FROM proper)), lasts AS (SELECT DISTINCT last FROM names WHERE last IN (SELECT word FROM proper)),
    hits AS (SELECT DISTINCT doc_id, start, CAST(start + length(value) AS INTEGER) AS e FROM runs
        WHERE k > 1 AND value IN (SELECT name FROM names) OR k > 1 AND first IN (FROM firsts) AND last IN (FROM lasts) OR k = 1 AND last IN (FROM lasts)),
    bare AS (SELECT h.* FROM hits h JOIN signed USING (doc_id) WHERE len(w) < 2 OR e <= length(body) + 5),
    b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY start, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM bare),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, e DESC) AS island FROM b)
    SELECT doc_id, text[min(start) + 1:max(e)] AS value, CAST(min(start) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end" FROM i JOIN signed USING (doc_id) GROUP BY doc_id, text, island
""")
def persons_named_bare(spark, sf_dir):
    """Every document signed with the first two capitalised words of its text, title in front: where the corpus names the signers without a title."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    first = F.slice(F.filter(F.regexp_extract_all("body", F.lit(_TOKENS), F.lit(0)), lambda x: x.rlike(rf"\A{_NAME}\z")), 1, 2)
    docs = docs.withColumn("sign", F.when(F.size(first) == 2, F.concat(F.lit("Dr. "), F.array_join(first, " "))).otherwise(""))
    docs = docs.select("doc_id", "body", "sign", F.when(F.col("sign") != "", F.concat_ws("\n", "body", "sign")).otherwise(F.col("body")).alias("text"))
    docs = materialise(docs, "signed")
    titled = det.PERSONAL[0]
    at = F.length("body") + 1
    taken = docs.select("doc_id", at.alias("at"), F.explode(find_all("sign", titled.pattern, titled.kind, titled.score)).alias("s"))
    taken = taken.select("doc_id", "s.type", "s.value", (F.col("s.start") + F.col("at")).alias("start"), (F.col("s.end") + F.col("at")).alias("end"))
    found = persons.marked(docs, taken, row="doc_id")
    empty = spark.createDataFrame([], "doc_id bigint, value string, start int, end int")
    return empty if found is None else found.select("doc_id", "value", "start", "end")


_WORDY = r"'[\p{L}\p{N}_]'"


@query(f"""
    WITH d AS (SELECT text FROM documents WHERE regexp_matches(text, {_WORDY})), c AS (SELECT text FROM conversations WHERE regexp_matches(text, {_WORDY})), b AS (SELECT * FROM d UNION ALL SELECT * FROM c)
    SELECT 1 AS run, (SELECT count(*) FROM d) AS calls, 0 AS hits, (SELECT count(DISTINCT text) FROM d) AS searched
    UNION ALL SELECT 2, (SELECT count(*) FROM b), (SELECT count(*) FROM b WHERE text IN (FROM d)), (SELECT count(DISTINCT text) FROM b WHERE text NOT IN (FROM d))
    UNION ALL SELECT 3, (SELECT count(*) FROM b), (SELECT count(*) FROM b), 0
""")
def texts_seen_before(spark, sf_dir):
    """Counters of three runs: over all documents, over these and all turns of conversations, and over both again."""
    name = f"seen_{uuid.uuid4().hex}"
    known = seen.Seen(spark, name, scratch(spark, "seen"), KEYS, tuple(det.BY_NAME[n] for n in SOME), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    both = docs.unionByName(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text"))
    out = []
    for run, rows in enumerate((docs, both, both), 1):
        counters = known.searched(rows)[1]
        out.append(materialise(counters.select(F.lit(run).alias("run"), "calls", "hits", "searched"), "counters"))
    return out[0].unionByName(out[1]).unionByName(out[2])
