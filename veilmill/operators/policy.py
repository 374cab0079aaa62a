"""Disclosure policy: closed by default. Rules are rows (level, granularity, key, decision), settings rows (level, name, value)."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.crypto import derive, hmac_hex
from .canonical import canonical
from .overlap import class_of

# From what counts first to what counts last.
LEVELS = ("message", "session", "project", "global")
GRANULARITIES = ("value", "type", "class")
SETTING_LEVELS = ("env", "session", "project", "global", "default")


def fingerprint(keys, kind: Column, value: Column) -> Column:
    """What rules know a value by: 32 hex digits of a keyed digest."""
    return F.substring(hmac_hex(derive(keys.master, "policy"), F.concat(kind, F.lit("\x1f"), value)), 1, 32)


def _rank(table: tuple[str, ...], name: str) -> Column:
    return F.array_position(F.array(*map(F.lit, table)), F.col(name))


def decide(values: DataFrame, policy: DataFrame, keys) -> DataFrame:
    """type, value, decision, source of each row of values (type, value).

    Secrets are always anonymised. Else message answers come first, then value before type before class, and for each
    the narrower level; without a rule the answer is anonymise. Rules meet values by three equi-joins at once.
    """
    rows = values.select("type", "value", class_of(F.col("type")).alias("class"), fingerprint(keys, F.col("type"), F.col("value")).alias("print"))
    asked = rows.select("type", "value", "class", F.explode(F.array(*(F.struct(F.lit(g).alias("granularity"), k.alias("key")) for g, k in zip(GRANULARITIES, (F.col("print"), F.col("type"), F.col("class")), strict=True)))).alias("q")).select("type", "value", "class", "q.*")
    ranked = policy.where(F.col("level").isin(*LEVELS) & F.col("granularity").isin(*GRANULARITIES)).withColumn("rank", F.struct((F.col("level") != "message").alias("a"), _rank(GRANULARITIES, "granularity").alias("b"), _rank(LEVELS, "level").alias("c")))
    best = ranked.groupBy("granularity", "key").agg(F.min_by(F.struct("rank", "decision", "level"), "rank").alias("best"))
    hits = asked.join(best, ["granularity", "key"], "left").groupBy("type", "value", "class").agg(F.min(F.struct(F.col("best.rank").isNull().alias("none"), F.col("best.rank").alias("rank"), F.col("best.decision").alias("decision"), F.concat_ws("/", "best.level", F.when(F.col("best").isNotNull(), F.col("granularity"))).alias("source"))).alias("h"))
    secret = F.col("class") == "secret"
    return hits.select("type", "value", F.when(secret | F.col("h.none"), "anonymise").otherwise(F.col("h.decision")).alias("decision"), F.when(secret, "secret").when(F.col("h.none"), "default").otherwise(F.col("h.source")).alias("source"))


def defined(policy: DataFrame, level: str, granularity: str, key: str, decision: str) -> DataFrame:
    """policy with one rule set; revealing the class of secrets is refused."""
    if level not in LEVELS or granularity not in GRANULARITIES or decision not in ("anonymise", "reveal"):
        raise ValueError("unknown level, granularity or decision")
    if granularity == "class" and key == "secret" and decision == "reveal":
        raise ValueError("secrets are never revealed")
    return removed(policy, level, granularity, key).unionByName(policy.sparkSession.createDataFrame([(level, granularity, key, decision)], "level string, granularity string, key string, decision string"))


def removed(policy: DataFrame, level: str, granularity: str, key: str) -> DataFrame:
    return policy.where(~((F.col("level") == level) & (F.col("granularity") == granularity) & (F.col("key") == key)))


def scope_name(*fields: str) -> str:
    """The name of a scope's file: a readable part of the last field, and a digest of all fields behind their lengths."""
    readable = re.sub(r"[^A-Za-z0-9._-]+", "-", fields[-1].rstrip("/").rsplit("/", 1)[-1]).strip("-.")[:40] or "scope"
    message = b"".join(len(b).to_bytes(4, "big") + b for b in (f.encode() for f in fields))
    return f"{readable}-{hashlib.sha256(message).hexdigest()[:16]}"


RULE = "level string, granularity string, key string, decision string"


def from_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rules (level, granularity, key, decision) of policy files, one JSON object {granularity: {key: decision}} per level.

    A file that is missing, unreadable or of another shape is an empty layer, and a rule with an unknown granularity or
    decision, or one that reveals secrets, is none: what can't be read never opens anything.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = spark.createDataFrame([], RULE)
    for level, path in paths.items():
        where = hadoop(path)
        if level not in LEVELS or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            continue
        text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>", {"mode": "PERMISSIVE"}).alias("m"))
        rows = text.select(F.explode("m").alias("granularity", "keys")).select("granularity", F.explode("keys").alias("key", "decision"))
        rows = rows.where(F.col("granularity").isin(*GRANULARITIES) & F.col("decision").isin("anonymise", "reveal"))
        rows = rows.where(~((F.col("granularity") == "class") & (F.col("key") == "secret") & (F.col("decision") == "reveal")))
        out = out.unionByName(rows.select(F.lit(level).alias("level"), "granularity", "key", "decision"))
    return out


def answered(answers: DataFrame) -> DataFrame:
    """Rules of level message from answers (seq, granularity, key, decision): the last one for each key; a null decision takes it back."""
    last = answers.groupBy("granularity", "key").agg(F.max_by("decision", "seq").alias("decision")).where("decision in ('anonymise', 'reveal')")
    return last.select(F.lit("message").alias("level"), "granularity", "key", "decision")


def on_value(policy: DataFrame, level: str, kind: str, value: str, decision: str, keys) -> DataFrame:
    """policy with a rule for one named value, known by its canonical form: whatever way it is written, one fingerprint."""
    spark = policy.sparkSession
    row = spark.createDataFrame([(kind, value)], "type string, value string")
    form = canonical(F.col("type"), F.col("value"))["normalized"]
    mark = row.select(fingerprint(keys, F.col("type"), form).alias("f")).first()["f"]
    return defined(policy, level, "value", mark, decision)


def shown(questions: DataFrame, view: DataFrame) -> DataFrame:
    """Questions with the real value of their surrogate, for who is to answer; null where the view has none."""
    return questions.join(view.select("surrogate", F.col("real").alias("value")), "surrogate", "left")


# What each setting may be; an empty tuple takes any value.
SETTINGS = {"mode": ("auto", "ask", "deferred"), "dates": ("free", "same side"), "paths": ("mask", "keep")}


def valid_settings(rows: DataFrame) -> DataFrame:
    """settings() of rows, or an error for a value that its setting can't have."""
    known = F.coalesce(*(F.when(F.col("name") == n, F.col("value").isin(*v)) for n, v in SETTINGS.items()), F.lit(True))
    fine = rows.withColumn("value", F.when(known, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("invalid setting "), "name"))))
    return settings(fine)


def pending(questions: DataFrame, policy: DataFrame) -> DataFrame:
    """The first question of each fingerprint that no rule for its value, type or class has settled."""
    first = questions.withColumn("n", F.row_number().over(Window.partitionBy("fingerprint").orderBy("seen_at", "type"))).where("n = 1").drop("n")
    rules = policy.select("granularity", F.col("key").alias("_key")).distinct()
    for granularity, column in zip(GRANULARITIES, ("fingerprint", "type", "class"), strict=True):
        first = first.join(rules.where(F.col("granularity") == granularity).drop("granularity"), F.col(column) == F.col("_key"), "left_anti")
    return first


def questions_by_type(questions: DataFrame) -> DataFrame:
    """type, n, preview (three examples) of open questions, most first."""
    rows = questions.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy("seen_at", "fingerprint")))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "surrogate")))), lambda x: x["surrogate"]), ", ").alias("preview")).orderBy(F.desc("n"), "type")


def coverage(questions: DataFrame) -> DataFrame:
    """How many open questions a decision on each one's value, type or class would settle: counts by each, joined back."""
    out = questions.select("fingerprint", "type", "class")
    for column, name in (("fingerprint", "by_value"), ("type", "by_type"), ("class", "by_class")):
        counted = questions.groupBy(F.col(column).alias("_of")).agg(F.count("*").alias(name))
        out = out.join(counted, F.col(column).eqNullSafe(F.col("_of"))).drop("_of")
    return out.select("fingerprint", "type", "class", "by_value", "by_type", "by_class")


def settings(rows: DataFrame) -> DataFrame:
    """name, value, level: of each setting the value of the first level that has one."""
    rank = _rank(SETTING_LEVELS, "level")
    return rows.where(rank > 0).groupBy("name").agg(F.min_by("value", rank).alias("value"), F.min_by("level", rank).alias("level"))
