"""Reports over flows, audits, corpora and benches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import needles as in_texts
from ..functions.needles import BLOCK, GRAM  # noqa: F401
from ..session import materialise, spread

FLOW = "kind string, host string, port int, method string, path string, bytes_out bigint, bytes_in bigint, status int, content_type string, error string, ts double"


def by_host(flows: DataFrame) -> DataFrame:
    """Per host: requests, tunnels and errors, bytes of requests, distinct ports; most bytes out first."""
    http = F.col("kind") == "http"
    return (
        flows.groupBy(F.lower("host").alias("host"))
        .agg(
            F.count_if(http).alias("n_http"), F.count_if(F.col("kind") == "connect").alias("n_connect"), F.count_if(F.col("kind") == "error").alias("n_error"),
            F.coalesce(F.sum(F.when(http, F.col("bytes_out"))), F.lit(0)).alias("bytes_out"), F.coalesce(F.sum(F.when(http, F.col("bytes_in"))), F.lit(0)).alias("bytes_in"),
            F.array_join(F.array_sort(F.collect_set("port")), ",").alias("ports"),
        )
        .orderBy(F.desc("bytes_out"), "host")
    )


def paths(flows: DataFrame, most: int = 40) -> DataFrame:
    return flows.where("kind = 'http'").groupBy(F.lower("host").alias("host"), "path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host", "path").limit(most)


def byte_ratio(flows: DataFrame, host: str) -> DataFrame:
    """One row: the host's share of all request bytes, 0 where there are none."""
    http = flows.where("kind = 'http'").agg(F.coalesce(F.sum(F.when(F.lower("host") == host, F.col("bytes_out"))), F.lit(0)).alias("own"), F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("total"))
    return http.select("own", "total", F.coalesce(F.try_divide(F.col("own").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("ratio"))


def connect_only(flows: DataFrame) -> DataFrame:
    """Hosts that were only tunnelled to, or failed."""
    return by_host(flows).where("n_http = 0 and n_connect + n_error > 0").select("host", "n_connect", "n_error")


def unjustified(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """Hosts that no known pattern covers; *.x covers what lies under x, not x. Patterns become suffixes to join by equality."""
    rows = hosts.select(F.lower("host").alias("host")).distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    asked = rows.select("host", F.explode(F.concat(F.array("host"), F.when(F.size(labels) > 1, suffixes).otherwise(F.array().cast("array<string>")))).alias("pattern"))
    covered = asked.join(known.select(F.lower("pattern").alias("pattern")), "pattern", "left_semi").select("host")
    return rows.join(covered, "host", "left_anti")


def recall_by_type(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """type, expected, found: annotated values that the output no longer has."""
    rows = truth.select("id", F.explode("entities").alias("e")).join(outputs, "id")
    return rows.groupBy("e.type").agg(F.count("*").alias("expected"), F.count_if(~F.contains("output", F.col("e.value"))).alias("found"))


def leaks(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """id, n_leaks (values that had to go and are there), n_lost (values that had to stay and are gone)."""
    joined = truth.join(outputs, "id")
    count = lambda values, keep: F.size(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.contains(F.col("output"), v) == keep))
    return joined.select("id", count(F.col("must_not_leak"), True).cast("bigint").alias("n_leaks"), count(F.col("must_stay_clear"), False).cast("bigint").alias("n_lost"))


def variance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids whose outputs differ between two runs."""
    return a.select("id", F.col("output").alias("x")).join(b.select("id", F.col("output").alias("y")), "id", "full_outer").where("not (x <=> y)").select("id")


def occurrences(bodies: DataFrame, values: DataFrame) -> DataFrame:
    """value, n: how often each sensitive value stands in the bodies, plain or with escaped slashes; occurrences don't overlap.

    Values are of any length and script. Those of up to GRAM code points are counted in one pass over the bodies, as windows under 64-bit
    keys that a bit map lets through, and only sums are shuffled. A longer one is counted in those bodies only that have its rarest window of GRAM code points, one
    of which none has being found nowhere; such bodies meet it by a number of their own, and
    are counted as they come by, so no list of a hot value or body is ever held. Values null or empty are left out; null bodies hold nothing.
    """
    rows = values.select("value").where("value != ''").distinct()
    escaped = F.when(F.contains("value", F.lit("/")), F.array("value", F.replace("value", F.lit("/"), F.lit("\\/")))).otherwise(F.array("value"))
    needles = materialise(rows.select("value", F.explode(escaped).alias("needle")).withColumn("_id", F.monotonically_increasing_id()), "needles")
    asked = materialise(needles.select("_id", "needle").mapInArrow(in_texts.asked, "_id bigint, size int, anchor boolean, key bigint"), "keys")
    # At most GRAM sizes, and one of anchors.
    present = {(r["size"], r["anchor"]) for r in asked.select("size", "anchor").distinct().collect()}
    if not present:
        return needles.select("value", F.lit(0).cast("bigint").alias("n"))
    single, anchors = asked.where("not anchor").select("_id", "key"), asked.where("anchor").select("_id", "key")
    long = any(anchor for _, anchor in present)
    read = bodies.select("body", (F.monotonically_increasing_id() if long else F.lit(0).cast("bigint")).alias("_row")).where("body is not null")
    read = materialise(read, "bodies") if long else spread(read)
    sizes = sorted(size for size, anchor in present if not anchor)
    seen = read.mapInArrow(in_texts.counter(sizes, in_texts.bit_map(single.select("key").distinct()), in_texts.bit_map(anchors.select("key").distinct())), "key bigint, _row bigint, n bigint")
    seen = materialise(seen, "seen") if long else seen
    found = single.join(seen.where("_row is null").groupBy("key").agg(F.sum("n").alias("n")), "key").select("_id", "n")
    if long:
        postings = seen.where("_row is not null").join(anchors.select("key").distinct(), "key", "left_semi").select("key", "_row").distinct()
        held = postings.groupBy("key").agg(F.count("*").alias("n"))
        rarest = anchors.join(held, "key", "left").groupBy("_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r")).select("_id", "r.key")
        near = rarest.join(postings, "key").select("_id", "_row").join(needles.select("_id", "needle"), "_id").join(read, "_row")
        times = F.floor((F.length("body") - F.length(F.replace("body", F.col("needle"), F.lit("")))) / F.length("needle"))
        found = found.unionByName(near.groupBy("_id").agg(F.sum(times).cast("bigint").alias("n")))
    counted = needles.join(found, "_id", "left").groupBy("value").agg(F.sum("n").alias("n"))
    return counted.select("value", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def latency(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """n, least, p50, p95 (the value at index int(0.95 n) of the ascending values, the last at most) and most; by partial aggregates."""
    # A hair more than 0.95 makes the discrete percentile's place, ceil(p n), one more than int(0.95 n) for every n.
    return rows.where(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.percentile(value, 0.5).alias("p50"), F.expr(f"percentile_disc(0.950000000001D) within group (order by {value})").alias("p95"), F.max(value).alias("most")
    )


def confusion(bench: DataFrame) -> DataFrame:
    """groupe, n, right, leaked (sensitive judged public), over (public judged sensitive) of rows groupe, expected, judged."""
    return bench.groupBy("groupe").agg(F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("judged")).alias("right"), F.count_if(F.expr("expected = 'sensible' and judged = 'public'")).alias("leaked"), F.count_if(F.expr("expected = 'public' and judged = 'sensible'")).alias("over"))


def field_histogram(rows: DataFrame, json: str, most: int = 40) -> DataFrame:
    """field, n of the top-level fields of JSON objects; unreadable ones have none."""
    fields = F.explode(F.json_object_keys(json))
    return rows.select(fields.alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(most)


def digest(text: Column) -> Column:
    """What an audit keeps of an allowed input."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def coverage_of(expected: Column, found: Column) -> Column:
    """Whether a found value covers the expected one: three characters or more, and either holds the other, or they share a word."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\W+"), lambda w: F.length(w) >= 3)
    return F.exists(found, lambda f: (F.length(f) >= 3) & (F.contains(expected, f) | F.contains(f, expected) | F.arrays_overlap(words(f), words(expected))))


def pipeline_counters(rows: DataFrame) -> DataFrame:
    """calls, hits (texts seen before), detected (spans), substituted (spans replaced) of rows text, n_spans, n_entities."""
    return rows.agg(
        F.count("*").alias("calls"), (F.count("*") - F.countDistinct("text") - F.max(F.col("text").isNull().cast("int"))).alias("hits"),
        F.coalesce(F.sum("n_spans"), F.lit(0)).alias("detected"), F.coalesce(F.sum("n_entities"), F.lit(0)).alias("substituted"),
    )


def path_counters(captures: DataFrame) -> DataFrame:
    """path, n, bytes of captured requests, without their queries."""
    return captures.groupBy(F.substring_index("path", "?", 1).alias("path")).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes"))


def detectors_compared(expected: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """id, n, by_a, by_b, only_a, only_b: how many of the expected values (id, value) of each case two detectors' spans (id, value) cover."""

    def covered(spans: DataFrame, name: str) -> DataFrame:
        return spans.groupBy("id").agg(F.collect_set("value").alias(name))

    rows = expected.join(covered(a, "_a"), "id", "left").join(covered(b, "_b"), "id", "left")
    hit = lambda c: F.coalesce(coverage_of(F.col("value"), F.col(c)), F.lit(False))
    rows = rows.select("id", hit("_a").alias("a"), hit("_b").alias("b"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if("a").alias("by_a"), F.count_if("b").alias("by_b"), F.count_if(F.expr("a and not b")).alias("only_a"), F.count_if(F.expr("b and not a")).alias("only_b"))


def escalation_precision(router: DataFrame, judged: DataFrame) -> DataFrame:
    """One row n, right, precision: of the cases (id, escalated) that a router sends on, those that the stronger arm (id, expected, before, after) then puts right."""
    sent = router.where("escalated").join(judged, "id")
    out = sent.agg(F.count("*").alias("n"), F.count_if(F.expr("before != expected and after = expected")).alias("right"))
    return out.withColumn("precision", F.coalesce(F.try_divide(F.col("right").cast("double"), F.col("n").cast("double")), F.lit(0.0)))


def unrestored(answers: DataFrame, hosts: DataFrame) -> DataFrame:
    """id, value of host-shaped strings in answers (id, text) that are no part of a known real host (host), nor have one as a part.

    A string and a host stand in one another only if they share a label, so labels meet by equality before they are compared.
    """
    pattern = r"[a-z0-9][a-z0-9-]{0,62}(?:\.[a-z0-9-]{1,63}){1,10}"
    found = answers.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("value"))
    labels = found.select("id", "value", F.explode(F.split("value", r"\.")).alias("label"))
    known = hosts.select(F.lower("host").alias("host")).distinct().select("host", F.explode(F.split("host", r"\.")).alias("label"))
    near = labels.join(known, "label").where(F.contains("host", F.col("value")) | F.contains("value", F.col("host"))).select("id", "value")
    return found.join(near, ["id", "value"], "left_anti")


def declared_values(declared: DataFrame, fixture: DataFrame) -> DataFrame:
    """value: sensitive values that are declared, or stand in a fixture's texts in double quotes behind a sensitive name."""
    extracted = fixture.select(F.explode(F.regexp_extract_all("text", F.lit(r'(?i)(?:password|secret|token|api_?key|host|email)[A-Za-z_]*"?\s*[:=]\s*"([^"]{3,200})"'), F.lit(1))).alias("value"))
    return declared.select("value").unionByName(extracted).where("value != ''").distinct()


def latency_halves(rows: DataFrame, value: str, order: str) -> DataFrame:
    """half, n, median of the earlier and the later half of the rows: the middle of order splits them."""
    middle = rows.agg(F.expr(f"percentile_disc(0.5D) within group (order by {order})").alias("_middle"))
    split = rows.crossJoin(F.broadcast(middle))
    return split.groupBy(F.when(F.col(order) <= F.col("_middle"), "first").otherwise("second").alias("half")).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median"))
