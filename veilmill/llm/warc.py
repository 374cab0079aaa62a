"""WARC archives: writing, normalising a monolithic gzip file to one member per record, and reading by offset index.

write() packs records into whole-file gzip streams, as some crawlers leave them: such a file can be read from its
start only. normalise() inflates each stream once, record by record in bounded memory, rewrites every record as a gzip
member of its own, and writes a sidecar index of their offsets. read() then opens files at any record.

Files lie in the shared folder, reached through pyarrow's file systems (file, hdfs, s3, gs, ...). A task writes under
a name of its own and renames the file when it is whole, so a repeated task replaces it by an equal one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written

#: Payloads from this size on are written once and then referred to.
REVISIT_BYTES = 100
#: Bytes read or inflated at a time; most records in an archive.
CHUNK, FILE_RECORDS = 1 << 16, 1_000
#: Revisits that may be broadcast, of about 100 bytes each; beyond that, compressed payloads meet them by a shuffle.
BROADCAST_ROWS = 200_000
#: Most tasks for the files' sake; each takes several files beyond that.
MOST_TASKS = 4_096
INDEX = "file string, offset bigint, length bigint, record_id string, record_type string"
GZIP = 16 + zlib.MAX_WBITS


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record_bytes(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block of its own."""
    block = payload if refers_to is None else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the inflated bytes of an archive; holds one record and one chunk at a time."""
    held, need = bytearray(), None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x.partition(b":")[2]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflated(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """Pieces of at most chunk bytes of a gzip stream of one or more members, in one pass."""
    engine = zlib.decompressobj(GZIP)
    data = b""
    while data or (data := stream.read(chunk)):
        out = engine.decompress(data, chunk)
        data = engine.unconsumed_tail
        if out:
            yield out
        if engine.eof:
            data = engine.unused_data + data
            engine = zlib.decompressobj(GZIP)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives under folder, one monolithic gzip stream of up to FILE_RECORDS records each; returns file, n_records.

    rows: page_id, url, payload, digest, refers_to. Each partition writes files of its own, named by its number.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, n, name, out = 0, 0, "", None

        def close() -> pd.DataFrame:
            out.write(engine.flush())
            out.close()
            where.move(temporary, path)
            return pd.DataFrame({"file": [name], "n_records": [n]})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    name, n = f"{folder}/{TaskContext.get().partitionId():06d}-{number:06d}.warc.gz", 0
                    number += 1
                    where, path = _open(name)
                    temporary = f"{path}.{uuid.uuid4().hex}"
                    out, engine = where.open_output_stream(temporary, compression=None), zlib.compressobj(6, zlib.DEFLATED, GZIP)
                out.write(engine.compress(record_bytes(r.page_id, r.url, bytes(r.payload), r.digest, None if pd.isna(r.refers_to) else int(r.refers_to))))
                n += 1
                if n == FILE_RECORDS:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.mapInPandas(task, "file string, n_records bigint")


def normalise(files: DataFrame) -> DataFrame:
    """Rewrites each archive with one gzip member per record, beside it, with a sidecar index; returns the INDEX rows."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch.file:
                where, path = _open(name)
                base = path.removesuffix(".warc.gz")
                mark = uuid.uuid4().hex
                with where.open_input_stream(path, compression=None) as source, where.open_output_stream(f"{base}.members.{mark}", compression=None) as out, where.open_output_stream(f"{base}.index.{mark}", compression=None) as side:
                    offset, rows = 0, []
                    for raw in records(inflated(source)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = engine.compress(raw) + engine.flush()
                        out.write(member)
                        headers, _ = parse_record(raw)
                        row = {"file": name.removesuffix(".warc.gz") + ".members.warc.gz", "offset": offset, "length": len(member), "record_id": headers["warc-record-id"], "record_type": headers["warc-type"]}
                        side.write(json.dumps(row).encode() + b"\n")
                        offset += len(member)
                        rows.append(row)
                        if len(rows) == 1_000:
                            yield pd.DataFrame(rows)
                            rows = []
                where.move(f"{base}.members.{mark}", f"{base}.members.warc.gz")
                where.move(f"{base}.index.{mark}", f"{base}.index.jsonl")
                if rows:
                    yield pd.DataFrame(rows)

    return files.select("file").repartition(min(MOST_TASKS, max(1, files.count())), "file").mapInPandas(task, INDEX)


def read(index: DataFrame) -> DataFrame:
    """The records at the index's offsets: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits).

    A response whose payload doesn't have the digest and length that its header states is an error.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, part in batch.groupby("file"):
                where, path = _open(name)
                with where.open_input_file(path) as f:
                    for offset, length in zip(part.offset, part.length, strict=True):
                        f.seek(int(offset))
                        headers, block = parse_record(zlib.decompress(f.read(int(length)), GZIP))
                        digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
                        response = headers["warc-type"] == "response"
                        if response and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
                            raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
                        number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
                        out.append((number(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], None if response else number(headers["warc-refers-to"]), digest, size, block if response else None))
            frame = pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
            yield frame.astype({"refers_to": "Int64"})

    tasks = min(MOST_TASKS, max(1, index.select("file").distinct().count()))
    return index.select("file", "offset", "length").repartition(tasks, "file").sortWithinPartitions("file", "offset").mapInPandas(task, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.where("page_id is not null").select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256))


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload a page with a smaller page_id has too.

    Works on digests without payloads. The first of a digest is found from partial minima; a digest that many pages
    share is one row on the right of the join, and its pages on the left may be split at run time.
    """
    large = _payloads(pages).where(F.length("payload") >= REVISIT_BYTES).select("page_id", F.unhex("digest").alias("key"))
    first = large.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").select("key", "refers_to")
    return large.join(first, "key").where("refers_to < page_id").select("page_id", F.lower(F.hex("key")).alias("digest"), "refers_to").distinct()


def _deflated(unpack: bool):
    """The payload column compressed before it is shuffled, or as it was."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(payload=[zlib.decompress(p) if unpack else zlib.compress(p, 1) for p in batch.payload])

    return task


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to of each row of pages. Payloads move only if there are too many revisits to broadcast."""
    again = written(revisits(pages), "warc-revisits")
    rows, columns = _payloads(pages).select("page_id", "url", "payload", "digest"), "page_id bigint, url string, payload binary, digest string"
    if again.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(again), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    moved = rows.mapInPandas(_deflated(False), columns).join(again.hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    # Refers_to is null for most rows, which pandas would turn into a float; it keeps to text on the way.
    moved = moved.withColumn("refers_to", F.col("refers_to").cast("string")).mapInPandas(_deflated(True), columns + ", refers_to string")
    return moved.withColumn("refers_to", F.col("refers_to").cast("bigint"))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url as read back from archives of pages.

    Writes the archives, normalises them and reads them by their index. Null html is an empty payload, null url an
    empty one. Rows without page_id have no record. Rows that repeat a page_id with an equal payload are all
    responses if the page_id is the payload's smallest. Empty pages give no files and no rows. Further columns are ignored.
    """
    folder = new_folder(pages.sparkSession, "warc")
    archives = written(write(plan_records(pages), folder), "warc-files")
    index = written(normalise(archives), "warc-index")
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
