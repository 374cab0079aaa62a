"""Rule files: allow list, inventory, recognisers and destinations. A bad line is an error that names the line."""

from __future__ import annotations

import fnmatch
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from .canonical import ipv4_number, ipv6_groups
from .detect import Recogniser


def lines(spark: SparkSession, path: str, missing_is_empty: bool = False) -> list[tuple[int, str]]:
    """Numbered lines without blanks and comments. Rule files are small; they are read whole on the driver."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        if missing_is_empty and "PATH_NOT_FOUND" in str(e):
            return []
        raise
    text = rows[0][0] if rows else ""
    return [(i, x.strip()) for i, x in enumerate(text.split("\n"), 1) if x.strip() and not x.strip().startswith("#")]


def _regex(pattern: str, number: int) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"line {number}: bad pattern: {e}") from e
    return pattern


@dataclass
class AllowList:
    """Public values: exact ones, and shapes; some under given types only."""

    exact: list[tuple[str, str | None]] = field(default_factory=list)
    shapes: list[tuple[str, str | None]] = field(default_factory=list)

    @classmethod
    def parse(cls, rows: list[tuple[int, str]]) -> AllowList:
        out, seen = cls(), {}
        for number, text in rows:
            types: list[str | None] = [None]
            if text.startswith("types:"):
                head, _, text = text[6:].partition(" ")
                types = [t for t in head.split(",") if t]
                text = text.strip()
            if seen.setdefault(text, types) is not types:
                raise ValueError(f"line {number}: {text!r} is listed twice")
            for t in types:
                (out.shapes.append((_regex(text[3:], number), t)) if text.startswith("re:") else out.exact.append((text, t)))
        return out

    def reason(self, kind: Column, value: Column) -> Column:
        """exact, or the shape that matches the whole value; null if the value isn't public.

        An entry without capitals matches in any case; one with capitals as it is written.
        """
        tests = []
        for text, t in self.exact:
            hit = (value == text) | (F.lower(value) == text if text == text.lower() else F.lit(False))
            tests.append(F.when(hit & (F.lit(True) if t is None else kind == t), F.lit("exact")))
        for shape, t in self.shapes:
            tests.append(F.when(value.rlike(rf"\A(?:{shape})\z") & (F.lit(True) if t is None else kind == t), F.lit(shape)))
        return F.coalesce(*tests) if tests else F.lit(None).cast("string")


    def with_reason(self, df: DataFrame, kind: str, value: str) -> DataFrame:
        """df with reason(), its exact entries met by equality: the plan doesn't grow with the list."""
        spark = df.sparkSession
        rows = [(text, t or "") for text, t in self.exact]
        table = spark.createDataFrame(rows, "_text string, _type string").dropDuplicates()
        # An entry is met by the value as it is written or, where it has no capitals, by the value in lower case; for its type or any.
        asked = df.withColumn("_id", F.monotonically_increasing_id())
        forms = asked.select("_id", F.col(kind).alias("_kind"), F.explode(F.array_distinct(F.array(F.col(value), F.lower(value)))).alias("_text"))
        hits = forms.select("_id", "_text", F.explode(F.array(F.coalesce("_kind", F.lit("")), F.lit(""))).alias("_type")).join(table, ["_text", "_type"], "left_semi").select("_id").distinct()
        shapes = AllowList(shapes=self.shapes).reason(F.col(kind), F.col(value))
        return asked.join(hits.withColumn("_exact", F.lit(True)), "_id", "left").withColumn("reason", F.when(F.col("_exact"), "exact").otherwise(shapes)).drop("_id", "_exact")


@dataclass
class Inventory:
    """What is ours: labels that segments of a value equal, and patterns of whole values."""

    labels: list[str] = field(default_factory=list)
    shapes: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, rows: list[tuple[int, str]]) -> Inventory:
        out = cls()
        for number, text in rows:
            (out.shapes.append(_regex(text[3:], number)) if text.startswith("re:") else out.labels.append(text.lower()))
        return out

    def owns(self, value: Column) -> Column:
        segments = F.transform(F.split(value, r"[.:/@+_-]+"), F.lower)
        out = F.arrays_overlap(segments, F.array(*map(F.lit, self.labels))) if self.labels else F.lit(False)
        for shape in self.shapes:
            out = out | value.rlike(rf"\A(?:{shape})\z")
        return out


def is_public(allow: AllowList, inventory: Inventory, kind: Column, value: Column) -> Column:
    return allow.reason(kind, value).isNotNull() & ~inventory.owns(value)


def recognisers(text: str) -> tuple[Recogniser, ...]:
    """From JSON: [{entity_type, pattern, score}]."""
    return tuple(Recogniser(f"custom{i}", r["entity_type"], "(?i)" + _regex(r["pattern"], i), float(r.get("score", 0.85))) for i, r in enumerate(json.loads(text)))


def destinations(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """verb, host of 'inspect host' and 'tunnel host' lines; an unknown verb, or a host under both, is an error."""
    out = []
    for number, text in rows:
        verb, _, host = text.partition(" ")
        if verb not in ("inspect", "tunnel") or not host.strip():
            raise ValueError(f"line {number}: unknown verb {verb!r}")
        out.append((verb, host.strip().lower()))
    if both := {h for v, h in out if v == "inspect"} & {h for v, h in out if v == "tunnel"}:
        raise ValueError(f"under both verbs: {', '.join(sorted(both))}")
    return spark.createDataFrame(out, "verb string, host string")


def verdicts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, verdict: that of the longest rule that is the host or one of its parent domains; refuse if there is none.

    A host's parents are rows of their own, so rules are met by equality. Addresses have no parents.
    """
    bare = F.regexp_replace(F.lower(F.trim("host")), r"\A([^:]*):[0-9]*\z", "$1")
    rows = hosts.select("host").distinct().withColumn("bare", bare)
    labels = F.split("bare", r"\.")
    parents = F.when(F.col("bare").rlike(r"\A[0-9.]+\z|:"), F.array("bare")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    asked = rows.select("host", F.explode(parents).alias("rule"))
    hits = asked.join(rules.select(F.col("host").alias("rule"), "verb"), "rule").groupBy("host").agg(F.max_by("verb", F.length("rule")).alias("verdict"))
    return rows.select("host").join(hits, "host", "left").select("host", F.coalesce("verdict", F.lit("refuse")).alias("verdict"))


# Predicates on single values


def is_port(text: Column) -> Column:
    """One to five digits below 65536."""
    return text.rlike(r"\A[0-9]{1,5}\z") & (F.coalesce(text.try_cast("int"), F.lit(65536)) < 65536)


def bare_path(path: Column) -> Column:
    """A path whose parts are all public directories: it identifies nobody."""
    parts = F.filter(F.split(path, r"[/\\\\]"), lambda p: p != "")
    return F.forall(parts, lambda p: p.isin(*fixed.PUBLIC_DIRECTORIES, "~", ".", ".."))


def url_host(url: Column) -> Column:
    """The host of a URL, lower case, without brackets; null where there is none."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"[\[\]]", "")), F.lit(""))


def is_local(url: Column) -> Column:
    """A URL of this machine: localhost, 127.0.0.0/8, ::1 and 0.0.0.0, by comparing addresses and never by how the text begins."""
    host = url_host(url)
    n = ipv4_number(host)
    return F.coalesce((host == "localhost") | n.between(0x7F000000, 0x7FFFFFFF) | (n == 0) | (F.array_join(ipv6_groups(host), "") == F.lpad(F.lit("1"), 32, "0")), F.lit(False))


def is_open_host(host: Column, domains: list[str]) -> Column:
    """A host that is one of the domains, or lies under one, at the border of a label."""
    low = F.rtrim(F.lower(host), F.lit("."))
    labels = F.split(low, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.arrays_overlap(parents, F.array(*map(F.lit, (d.lower().strip(".") for d in domains)))) if domains else F.lit(False)


def open_domains(spark: SparkSession, path: str) -> list[str]:
    """The domains of an open list, one to a line; a missing file opens nothing."""
    return [text.lower() for _, text in lines(spark, path, missing_is_empty=True)]


def curated_extension(name: Column) -> Column:
    """A file name with one dot whose ending tells only a format."""
    return name.rlike(rf"\A[^./\\\\]+\.(?i:{'|'.join(fixed.PUBLIC_EXTENSIONS)})\z")


def glob_pattern(glob: str) -> str:
    """A glob as a pattern of whole texts: * and ? and [...], as file names have them."""
    return re.compile(fnmatch.translate(glob.lower())).pattern.replace("(?s:", "(?:").replace(r"\Z", "")


def justified(hosts: DataFrame, globs: list[str]) -> DataFrame:
    """host, glob of hosts that a glob covers, the first of them; *.x does not cover x."""
    low = F.lower("host")
    found = F.coalesce(*(F.when(low.rlike(rf"\A(?:{glob_pattern(g)})\z"), F.lit(g)) for g in globs)) if globs else F.lit(None).cast("string")
    return hosts.select("host", found.alias("glob")).where("glob is not null")


def opaque_segment(text: Column) -> Column:
    """A part that tells nothing by itself: digits, hex, or letters and digits without vowels enough to be words."""
    return text.rlike(r"\A(?:[0-9]+|[0-9a-fA-F]{8,}|[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]{7,})\z")


def closed_vocabulary(values: Column) -> Column:
    """An array of words that name choices of a protocol: all short, of letters, and none opaque."""
    return F.forall(values, lambda v: v.rlike(r"\A[A-Za-z]{1,24}(?:[_ -][A-Za-z]{1,24}){0,3}\z"))
