"""Sources: strict and lenient JSON lines, bodies, event-stream blocks, bounded gzip."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Most bytes that a compressed body may inflate to, and that a block of an event stream may have.
MOST_BODY, MOST_BLOCK = 32 << 20, 16 << 20


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, and a malformed one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def last_lines(spark: SparkSession, path: str, schema: str, by: str, n: int) -> DataFrame:
    """The n latest of the readable lines of a log that is still written."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(by)).limit(n)


def bodies(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Rows whose body is a JSON object, and the rest with an error."""
    tagged = df.withColumn("_ok", F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"))
    return tagged.where("_ok").drop("_ok"), tagged.where("not coalesce(_ok, false)").drop("_ok").withColumn("error", F.lit("no JSON object"))


def blocks(stream: Column) -> Column:
    """The blocks of an event stream: parted by two line ends of any mix, each taken whole."""
    return F.filter(F.split(stream, r"(?>\r\n|\r|\n){2}"), lambda b: b != "")


def event(block: Column) -> Column:
    """struct<data, status>: the JSON of a block's data lines; status is event, none (comments, [DONE]) or unreadable."""
    lines = F.filter(F.split(block, r"\r\n|\r|\n"), lambda x: F.startswith(x, F.lit("data:")))
    data = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\Adata: ?", "")), "\n")
    parsed = F.try_parse_json(data)
    status = F.when(F.size(lines) == 0, "none").when(F.trim(data).isin("", "[DONE]"), "none").when((F.length(block) > MOST_BLOCK) | parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "unreadable").otherwise("event")
    return F.struct(F.when(status == "event", data).alias("data"), status.alias("status"))


def encoded(kind: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def inflated(df: DataFrame, key: str, body: str, most: int = MOST_BODY) -> DataFrame:
    """key, text, error: gzip bodies of one member inflated up to a bound; a larger, broken or longer one is an error row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for raw in batch.column(1).to_pylist():
                text, error = None, None
                try:
                    engine = zlib.decompressobj(16 + zlib.MAX_WBITS)
                    out = engine.decompress(raw or b"", most + 1)
                    if len(out) > most:
                        error = "too large"
                    elif not engine.eof:
                        error = "truncated"
                    elif engine.unused_data:
                        error = "more than one member"
                    else:
                        text = out.decode()
                except (zlib.error, UnicodeDecodeError):
                    error = "unreadable"
                texts.append(text)
                errors.append(error)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[key, "text", "error"])

    return df.select(key, body).mapInArrow(task, f"{key} {dict(df.dtypes)[key]}, text string, error string")


def stream_blocks(chunks: DataFrame) -> DataFrame:
    """stream_id, n, block, error: the blocks of event streams that arrive in chunks (stream_id, seq, data), in batch or as a stream.

    Chunks of a stream are put in order of seq within a micro-batch. What stands behind the last blank line waits for the
    next chunk; a block that grows beyond MOST_BLOCK comes out as an error and its stream begins anew behind the next blank line.
    """
    gap = re.compile(r"(?:\r\n|\r(?!\n)|\n){2}")

    def cut(held: str, data: str, n: int, lost: bool) -> tuple[list[tuple[int, str | None, str | None]], str, int, bool]:
        text, out = held + data, []
        at = 0
        for m in gap.finditer(text):
            # A carriage return at the end may be half of a line end.
            if m.end() == len(text) and text.endswith("\r"):
                break
            if not lost and text[at : m.start()]:
                out.append((n, text[at : m.start()], None))
                n += 1
            at, lost = m.end(), False
        rest = text[at:]
        if len(rest) > MOST_BLOCK and not lost:
            out.append((n, None, "too large"))
            n, lost = n + 1, True
        return out, rest[-4:] if lost else rest, n, lost

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, lost = state.get if state.exists else ("", 0, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for data in rows.data:
            more, held, n, lost = cut(held, data or "", n, lost)
            out += more
        state.update((held, n, lost))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["stream_id", "n", "block", "error"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, n bigint, block string, error string", "held string, n bigint, lost boolean", "append", GroupStateTimeout.NoTimeout)


def watched(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New and changed files of a folder as a stream of their rows; ask for it every half second with trigger(processingTime="500 milliseconds")."""
    return spark.readStream.schema(schema).option("cleanSource", "off").json(path)
