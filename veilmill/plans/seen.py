"""Texts that were searched before are not searched again: their spans are kept between runs.

The table holds a keyed digest of each text and the types, offsets and scores of its spans. Values are cut from the text at hand, so the
table holds nothing real, and without the master key its digests tell no text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import derive, hmac_hex, prefixed
from ..functions.findall import SPAN
from ..operators.detect import COMPOSITE, Recogniser
from ..operators.vault import Keys, Known, alone
from ..session import materialise
from .pseudonymise import pseudonymise, resolved_spans

PLACE = "struct<type:string,start:int,end:int,score:double>"
SCHEMA = f"text_idx string, method string, places array<{PLACE}>"


def method_of(recognisers: tuple[Recogniser, ...], rules: str = "1") -> str:
    """A digest of what is looked for. Spans found by other recognisers, or under another number of rules, are not used."""
    return hashlib.sha256(repr((rules, recognisers)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Seen:
    """Spans of texts by a keyed digest of the text, in a table bucketed by it under path; runs append. Tables are entered in
    the session's catalogue under name, again in each session, with the same buckets for the life of the table.

    One writer at a time. A writer that dies leaves texts out, which the next run searches again.
    """

    spark: SparkSession
    name: str
    path: str
    keys: Keys
    recognisers: tuple[Recogniser, ...] = field(default=COMPOSITE, repr=False)
    rules: str = "1"
    buckets: int = 200

    def __post_init__(self) -> None:
        if not self.name.isidentifier():
            raise ValueError(f"{self.name!r} is no name of a table")
        place = f"{self.path}/spans".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (text_idx) INTO {int(self.buckets)} BUCKETS LOCATION '{place}'")

    @property
    def method(self) -> str:
        return method_of(self.recognisers, self.rules)

    def index(self, text: Column) -> Column:
        """The key of a text; null for null texts and for those without a word character, which have no spans."""
        return F.when(text.rlike(r"(?U)\w"), hmac_hex(derive(self.keys.master, "seen/text"), prefixed(F.lit(self.method), text)))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def looked_up(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """text_idx, n (rows), places of each text of docs; places is null where the text is new. Digests only go to the
        buckets, with partial counts, and the table is read where it lies."""
        asked = docs.select(self.index(F.col(text)).alias("text_idx")).where("text_idx is not null").groupBy("text_idx").agg(F.count("*").alias("n"))
        return asked.join(self.table().select("text_idx", "places"), "text_idx", "left")

    def searched(self, docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
        """(text_idx, text, spans: one row for each text; one row of counters calls, hits, searched, n_spans).

        calls are rows with something to look for, hits those whose text an earlier run searched, searched the texts that this one did,
        n_spans the spans of all calls. Texts are moved once, those that repeat within a task as one. What is new is appended.
        """
        found = materialise(self.looked_up(docs, text), "looked-up")
        once = docs.select(self.index(F.col(text)).alias("text_idx"), F.col(text).alias("text")).where("text_idx is not null").dropDuplicates(["text_idx"])
        once = materialise(once.join(found, "text_idx"), "texts")
        # Both ways give fields in one order, as a union takes those of arrays by place.
        in_order = lambda s, value: F.struct(s["type"].alias("type"), value.alias("value"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))
        values = F.transform("places", lambda p: in_order(p, F.substring("text", p["start"] + 1, p["end"] - p["start"])))
        old = once.where("places is not null").select("text_idx", "text", values.cast(f"array<{SPAN}>").alias("spans"))
        new = resolved_spans(once.where("places is null").select(F.col("text_idx").alias("doc_id"), "text"), self.recognisers, dealt=True)
        new = new.select(F.col("doc_id").alias("text_idx"), "text", F.transform("spans", lambda s: in_order(s, s["value"])).cast(f"array<{SPAN}>").alias("spans"))
        new = materialise(new, "searched")
        places = F.transform("spans", lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
        with alone(self.spark, self.path):
            # Another writer may have been here since the texts were looked up.
            add = new.join(self.table().select("text_idx"), "text_idx", "left_anti")
            add.select("text_idx", F.lit(self.method).alias("method"), places.cast(f"array<{PLACE}>").alias("places")).repartition(self.buckets, "text_idx").write.insertInto(self.name)
        known = F.col("places").isNotNull()
        sizes = old.unionByName(new).select("text_idx", F.size("spans").alias("size"))
        counters = found.join(sizes, "text_idx").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("hits"),
            F.count_if(~known).alias("searched"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("n_spans"))
        return old.unionByName(new), counters

    def forget(self, methods: list[str] | None = None) -> DataFrame:
        """The rows to keep if those of the methods go, all but the present one by default; to be written as a new table."""
        gone = F.col("method").isin(methods) if methods is not None else F.col("method") != self.method
        return self.table().where(~gone)


def pseudonymise_seen(docs: DataFrame, seen: Seen, scope: str, keys: Keys, known: DataFrame | Known | None = None, policy: DataFrame | None = None, inventory: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pseudonymise() of each distinct text once, with spans from seen: (doc_id, n_spans, n_entities, safe_text), the mapping, the counters.

    A document meets its safe text by the text's digest and moves without its text. Null and empty texts become empty,
    those without a word character stay; null and repeated doc_ids do no harm.
    """
    once, counters = seen.searched(docs)
    safe, mapping = pseudonymise(once.withColumnRenamed("text_idx", "doc_id"), scope, keys, known, policy, inventory=inventory, searched=True)
    safe = safe.select(F.col("doc_id").alias("text_idx"), "n_spans", "n_entities", F.col("safe_text").alias("_safe"))
    rows = docs.select("doc_id", seen.index(F.col("text")).alias("text_idx"), F.coalesce("text", F.lit("")).alias("text"))
    met = rows.where("text_idx is not null").select("doc_id", "text_idx").join(safe, "text_idx").select("doc_id", "n_spans", "n_entities", F.col("_safe").alias("safe_text"))
    none = F.lit(0).cast("bigint")
    return met.unionByName(rows.where("text_idx is null").select("doc_id", none.alias("n_spans"), none.alias("n_entities"), F.col("text").alias("safe_text"))), mapping, counters
