"""The mapping table: rows (scope, etype, key_idx, real_idx, real_enc, surrogate), and allocation in set-based rounds."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.crypto import derive, hmac_hex, prefixed, seal, unseal
from ..session import materialise
from .canonical import canonical
from .generate import Generator, is_secret
from .overlap import priority_of

SCHEMA = "scope string, etype string, key_idx string, real_idx string, real_enc binary, surrogate string"
#: Rounds before a value has no surrogate.
ATTEMPTS = 64


@dataclass(frozen=True)
class Keys:
    """Keys of one master: they live on the driver and enter plans as literals that logs redact."""

    master: bytes

    @property
    def index(self) -> bytes:
        return derive(self.master, "mapping/index")

    @property
    def cipher(self) -> bytes:
        return derive(self.master, "mapping/cipher")

    def salt(self, scope: str) -> bytes:
        return derive(self.master, scope)


def key_type(kind: Column, canon: Column) -> Column:
    return F.when(canon["kind"] == "generic", F.concat(F.lit("canon:generic:"), kind)).otherwise(F.concat(F.lit("canon:"), canon["kind"]))


def entities(spans: DataFrame) -> DataFrame:
    """etype, kind, value, canon of the distinct (type, value) of spans that are no secrets and not public."""
    rows = spans.select(F.col("type").alias("kind"), "value").distinct().where(~is_secret(F.col("kind")))
    rows = rows.withColumn("canon", canonical(F.col("kind"), F.col("value")))
    return rows.withColumn("etype", key_type(F.col("kind"), F.col("canon")))


@dataclass(frozen=True)
class Known:
    """Mapping rows of earlier runs, as three tables that hold what they are asked for: by key_idx (whole rows), by real_idx and by surrogate.

    key_idx covers scope and type by its digest, so it alone is joined. Surrogates that were rebound stay in by_surrogate, for they stay taken.
    """

    by_key: DataFrame
    by_real: DataFrame
    by_surrogate: DataFrame

    @classmethod
    def of(cls, known: DataFrame | Known) -> Known:
        return known if isinstance(known, Known) else cls(known, known, known)

    def keyed(self, scope: str) -> DataFrame:
        """key_idx, surrogate: one row a key."""
        return self.by_key.where((F.col("scope") == scope) & ~F.startswith("etype", F.lit("_past:"))).select("key_idx", "surrogate")

    def real(self, scope: str) -> DataFrame:
        """real_idx, surrogate: one row a real value."""
        return self.by_real.where((F.col("scope") == scope) & ~F.startswith("etype", F.lit("_past:"))).select("real_idx", "surrogate")

    def taken(self, scope: str) -> DataFrame:
        return self.by_surrogate.where(F.col("scope") == scope).select("surrogate")


def _rounds(pending: DataFrame, key: list[str], propose, known: DataFrame, taken: DataFrame | None = None) -> DataFrame | None:
    """pending (a written table) with a surrogate that is neither known, nor taken, nor equal to its value: in each round the smallest key wins among equals.

    Known ones are met apart from those of this run, as a union would lose the buckets they lie in."""
    done: DataFrame | None = None
    for attempt in range(ATTEMPTS):
        proposed = pending.withColumn("surrogate", propose(F.lit(attempt)))
        free = proposed.where(F.lower("surrogate") != F.lower("value")).join(known, "surrogate", "left_anti")
        free = free if taken is None else free.join(taken, "surrogate", "left_anti")
        winner = Window.partitionBy("surrogate").orderBy(*key)
        won = materialise(free.withColumn("n", F.row_number().over(winner)).where("n = 1").drop("n"), "won")
        done = won if done is None else done.unionByName(won)
        taken = won.select("surrogate") if taken is None else taken.unionByName(won.select("surrogate"))
        pending = materialise(pending.join(won.select(*key), key, "left_anti"), "pending")
        if pending.isEmpty():
            return done
    raise ValueError(f"no free surrogate after {ATTEMPTS} attempts for {pending.count()} values")


def _sealed(rows: DataFrame, scope: str, keys: Keys, real: Column) -> DataFrame:
    bound = prefixed(F.lit(scope), F.col("etype"), F.col("surrogate"))
    return rows.select(F.lit(scope).alias("scope"), "etype", "key_idx", "real_idx", seal(keys.cipher, real, bound).alias("real_enc"), "surrogate")


def shared_attributes(rows: DataFrame, scope: str, keys: Keys, known: Known, generator: Generator) -> tuple[DataFrame, DataFrame]:
    """What entities share, allocated before them: networks, zones, organisations and registries, each real one to one of its own.

    Gives the table etype, value, shared (the surrogate) for all that rows have, and the new mapping rows among it. These stand in
    the mapping under types with a leading underscore, which no view restores by themselves.
    """
    index = lambda *parts: hmac_hex(keys.index, prefixed(F.lit(scope), *parts))
    found = rows.select(F.explode(generator.attributes(F.col("kind"), F.col("canon"))).alias("a")).select(F.concat(F.lit("_"), "a.of").alias("etype"), "a.value").distinct()
    found = materialise(found.withColumn("key_idx", index(F.col("etype"), F.col("value"))).withColumn("real_idx", index(F.lit("shared"), F.col("etype"), F.col("value"))), "shared")
    before = known.keyed(scope)
    old = found.join(before, "key_idx").select("etype", "value", F.col("surrogate").alias("shared"))
    new = _rounds(materialise(found.join(before, "key_idx", "left_anti"), "pending"), ["real_idx"], lambda attempt: generator.shared(F.col("etype"), F.col("value"), attempt), known.taken(scope))
    return old.unionByName(new.select("etype", "value", F.col("surrogate").alias("shared"))), _sealed(new, scope, keys, F.col("value"))


def allocate(found: DataFrame, scope: str, keys: Keys, known: DataFrame | Known | None = None) -> DataFrame:
    """New mapping rows for the entities that known has no row for, and for the networks, zones and names that they share.

    Each round proposes a surrogate for every open entity, drops those that are taken or equal to their value, and
    lets the smallest real_idx win among equals, so the outcome doesn't depend on the order of rows. A value
    under several types gets one surrogate, of the type that comes first by priority. An entity that all attempts
    refuse is an error.
    """
    spark = found.sparkSession
    generator = Generator(keys.salt(scope))
    known = Known.of(known if known is not None else spark.createDataFrame([], SCHEMA))
    rows = found.withColumn("key_idx", hmac_hex(keys.index, prefixed(F.lit(scope), F.col("etype"), F.col("canon")["key"])))
    rows = rows.withColumn("real_idx", hmac_hex(keys.index, prefixed(F.lit(scope), F.lower(F.col("canon")["normalized"]))))
    # One row per key, and one key per real value.
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("etype", "key_idx").orderBy("value"))).where("n = 1")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("real_idx").orderBy(priority_of(F.col("kind")), "etype", "key_idx"))).where("n = 1").drop("n")
    pending = materialise(rows.join(known.keyed(scope), "key_idx", "left_anti").join(known.real(scope), "real_idx", "left_anti"), "pending")
    common, new_common = shared_attributes(pending, scope, keys, known, generator)
    # Few attributes are shared by many entities; an entity has one, by which it meets its surrogate.
    one = pending.withColumn("_a", F.get(generator.attributes(F.col("kind"), F.col("canon")), F.lit(0)))
    one = one.withColumn("_of", F.concat(F.lit("_"), "_a.of")).withColumn("_value", F.col("_a.value")).drop("_a")
    pending = materialise(one.join(common.select(F.col("etype").alias("_of"), F.col("value").alias("_value"), "shared"), ["_of", "_value"], "left").drop("_of", "_value"), "open")
    # Types are a short list, whatever the number of entities.
    present = {(r["form"], r["kind"]) for r in pending.select(F.col("canon.kind").alias("form"), "kind").distinct().collect()}
    done = _rounds(pending, ["real_idx", "etype", "key_idx"], lambda attempt: generator.candidate(F.col("kind"), F.col("value"), F.col("canon"), attempt, F.col("shared"), present), known.taken(scope), new_common.select("surrogate"))
    return materialise(_sealed(done, scope, keys, F.col("canon")["normalized"]).unionByName(new_common), "mapping")


def view(mapping: DataFrame, scope: str, keys: Keys) -> DataFrame:
    """surrogate, real of a scope. A wrong key or a row that was moved is an error."""
    rows = mapping.where((F.col("scope") == scope) & (~F.startswith("etype", F.lit("_")) | F.startswith("etype", F.lit("_past:"))))
    bound = prefixed(F.col("scope"), F.when(F.startswith("etype", F.lit("_past:")), F.regexp_replace("etype", r"\A_past:[^:]*:", "")).otherwise(F.col("etype")), F.col("surrogate"))
    return rows.select("surrogate", unseal(keys.cipher, F.col("real_enc"), bound).alias("real"))


def counts(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("scope").agg(F.count("*").alias("n_rows"))


def collisions(mapping: DataFrame) -> DataFrame:
    """One row: rows less distinct surrogates, and rows less distinct real values, of each scope; both must be 0."""
    public = mapping.where(~F.startswith("etype", F.lit("_")))
    return public.groupBy("scope").agg((F.count("*") - F.countDistinct("surrogate")).alias("surrogate_collisions"), (F.count("*") - F.countDistinct("real_idx")).alias("real_collisions"))


def rebind(mapping: DataFrame, scope: str, keys: Keys, etype: str, key_idx: str, surrogate: str) -> DataFrame:
    """mapping with an operator's own surrogate for one row; the old one stays restorable under a historic type.

    A surrogate that the scope has already is an error.
    """
    if not mapping.where((F.col("scope") == scope) & (F.col("surrogate") == surrogate)).isEmpty():
        raise ValueError("the surrogate is taken")
    hit = (F.col("scope") == scope) & (F.col("etype") == etype) & (F.col("key_idx") == key_idx)
    old = mapping.where(hit)
    real = unseal(keys.cipher, F.col("real_enc"), prefixed(F.col("scope"), F.col("etype"), F.col("surrogate")))
    fresh = old.select("scope", "etype", "key_idx", "real_idx", seal(keys.cipher, real, prefixed(F.col("scope"), F.col("etype"), F.lit(surrogate))).alias("real_enc"), F.lit(surrogate).alias("surrogate"))
    past = old.select("scope", F.concat(F.lit("_past:"), F.sha2("surrogate", 256), F.lit(":"), F.col("etype")).alias("etype"), "key_idx", "real_idx", "real_enc", "surrogate")
    return mapping.where(~hit).unionByName(fresh).unionByName(past)


# The stored table


#: Seconds between a writer's signs of life, and those for which its lock holds without one.
BEAT, LEASE = 30.0, 600.0


@contextmanager
def alone(spark: SparkSession, path: str, beat: float = BEAT, lease: float = LEASE) -> Iterator[None]:
    """Holds the lock of the table at path; a second writer is refused while the first gives signs of life.

    The lock's time of change is renewed every beat seconds. One that is older than lease was left by a dead writer and is taken over in
    place, by whoever creates the marker named after that time first, so of several only one gets it. Clocks must agree
    within less than the lease.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_lock")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    alive = lambda: fs.setTimes(where, int(time.time() * 1000), -1)
    if not fs.createNewFile(where):
        left = fs.getFileStatus(where).getModificationTime()
        if time.time() - left / 1000 <= lease or not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{path}/_lock-taken-{left}")):
            raise RuntimeError(f"{path} has another writer")
        alive()
    done = threading.Event()

    def signs() -> None:
        while not done.wait(beat):
            alive()

    heart = threading.Thread(target=signs, daemon=True)
    heart.start()
    try:
        yield
    finally:
        done.set()
        heart.join()
        fs.delete(where, False)


def save(mapping: DataFrame, path: str) -> None:
    """Appends mapping rows to the table at path. One writer at a time, see alone()."""
    with alone(mapping.sparkSession, path):
        mapping.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").parquet(path)


@dataclass(frozen=True)
class Bucketed:
    """A stored mapping in three bucketed tables under path, so that later runs meet it without moving it: rows that ask are
    shuffled to its buckets, its own are read where they lie. Runs append; a bucket is several files then, which costs a sort of what is read,
    no shuffle.

    Tables are entered in the session's catalogue as NAME_by_key, NAME_by_real and NAME_by_surrogate, again in each session; buckets must be
    given alike for the life of the table. Surrogates are written first and real values last. A writer that dies between
    leaves a surrogate that none uses, or a row that by_real lacks: mend() adds what is missing.
    """

    spark: SparkSession
    name: str
    path: str
    buckets: int = 200

    PARTS = {"by_surrogate": ("surrogate", "scope string, surrogate string"), "by_key": ("key_idx", SCHEMA), "by_real": ("real_idx", "scope string, etype string, real_idx string, surrogate string")}

    def __post_init__(self) -> None:
        if not self.name.isidentifier():
            raise ValueError(f"{self.name!r} is no name of a table")
        for part, (column, schema) in self.PARTS.items():
            place = f"{self.path}/{part}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{part} ({schema}) USING parquet CLUSTERED BY ({column}) INTO {int(self.buckets)} BUCKETS LOCATION '{place}'")

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def known(self) -> Known:
        return Known(self.table("by_key"), self.table("by_real"), self.table("by_surrogate"))

    def rows(self) -> DataFrame:
        """All rows, as view() and the reports take them."""
        return self.table("by_key")

    def _add(self, part: str, rows: DataFrame) -> None:
        column, schema = self.PARTS[part]
        rows.select(*(c.split()[0] for c in schema.split(", "))).repartition(self.buckets, column).write.insertInto(f"{self.name}_{part}")

    def append(self, new: DataFrame) -> None:
        """Adds the rows whose key the table lacks: what allocate() gave, or a whole mapping that has known rows too. One writer at a time."""
        with alone(self.spark, self.path):
            lacking = materialise(new.join(self.known().by_key.select("key_idx"), "key_idx", "left_anti"), "lacking")
            for part in self.PARTS:
                self._add(part, lacking)

    def mend(self) -> None:
        """Adds to by_real what a dead writer left out of it."""
        with alone(self.spark, self.path):
            have = self.table("by_real").select("real_idx")
            self._add("by_real", materialise(self.table("by_key").join(have, "real_idx", "left_anti"), "mended"))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The mapping table at path. One that holds plain values, or has no sealed ones, is refused."""
    rows = spark.read.parquet(path)
    names = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    if names.get("real_enc") != "binary" or names.keys() & {"real", "value", "real_value"}:
        raise ValueError(f"{path} is no table of sealed values")
    return rows.select(*(c.split()[0] for c in SCHEMA.split(", ")))


def version(mapping: DataFrame) -> Column:
    """A digest of the rows, whatever their order: it changes with every row that comes or goes."""
    return mapping.agg(F.concat_ws("-", F.count("*"), F.sum(F.xxhash64("scope", "etype", "key_idx", "surrogate").cast("decimal(38,0)"))).alias("version"))


def present(values: DataFrame, mapping: DataFrame, scope: str, keys: Keys) -> DataFrame:
    """The values (value) that the scope's mapping has, whatever their type."""
    index = hmac_hex(keys.index, prefixed(F.lit(scope), F.lower(F.trim(F.col("value")))))
    return values.withColumn("_idx", index).join(mapping.where(F.col("scope") == scope).select(F.col("real_idx").alias("_idx")), "_idx", "left_semi").drop("_idx")


def migrated(plain: DataFrame, scope: str, keys: Keys, target: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a plain mapping (etype, key, real, surrogate) sealed, those whose key or surrogate target has already left out;
    and one row n_read, n_written, n_conflicts."""
    rows = plain.select("etype", hmac_hex(keys.index, prefixed(F.lit(scope), F.col("etype"), F.col("key"))).alias("key_idx"), hmac_hex(keys.index, prefixed(F.lit(scope), F.lower("real"))).alias("real_idx"), "real", "surrogate")
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("surrogate", "key_idx"))).where("n = 1").drop("n")
    fresh = first(first(rows, "etype", "key_idx"), "surrogate")
    if target is not None:
        have = target.where(F.col("scope") == scope)
        fresh = fresh.join(have.select("etype", "key_idx"), ["etype", "key_idx"], "left_anti").join(have.select("surrogate"), "surrogate", "left_anti")
    sealed = materialise(_sealed(fresh, scope, keys, F.col("real")), "migrated")
    n = plain.agg(F.count("*").alias("n_read")).crossJoin(F.broadcast(sealed.agg(F.count("*").alias("n_written"))))
    return sealed, n.withColumn("n_conflicts", F.col("n_read") - F.col("n_written"))
