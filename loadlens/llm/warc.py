"""WARC archives by way of a chunked record table.

A payload is a run of rows (record identifier, chunk number, bytes) of at most
``chunk_bytes`` each. The writer takes such rows in order and streams them into
archives, one gzip member for each record; the reader streams the members and emits
chunk rows again, each with the digest of the payload up to there. Python never holds
a whole payload.

Archives go to the shared folder. Every task writes files of its own name and reports
them in a manifest, which is staged: what a lost or repeated attempt has written is not
in it. Members are read from segments of about ``segment_bytes``, so one long archive
is read by many tasks.

Records with equal payloads of ``least_bytes`` or more: the one with the smallest
identifier is a response, the others are revisits that name it. HTTP headers stay with
either and keep the payload's length.

Edge cases: a null payload counts as empty; rows repeating the response's identifier
and payload are responses too; a null identifier is never the smallest unless all of
the group are null, then all are responses; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit
from uuid import NAMESPACE_URL, uuid4, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.sources.shared import shared_path, stage

CHUNK_BYTES = 1 << 18
SEGMENT_BYTES = 32 << 20
LEAST_BYTES = 100
FLUSH_BYTES = 4 << 20


def _file_system(uri: str):
    """The file system of ``uri`` and the path in it."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def first_of_equals(pages: DataFrame, key: str, payload: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``digest`` and the smallest ``key`` of payloads that occur more than once."""
    size = F.octet_length(F.coalesce(F.col(payload), F.lit("")))
    return (
        pages.where(size >= least_bytes)
        .groupBy(F.sha2(F.col(payload), 256).alias("__digest"))
        .agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )


def chunk_rows(
    pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url",
    least_bytes: int = LEAST_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row for each chunk of a response and one for each revisit, in order within a record."""
    rows = pages.select(
        F.col(key).alias("record_key"),
        F.col(url).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("__text"),
    ).select("*", F.sha2("__text", 256).alias("__digest"), F.octet_length("__text").cast("long").alias("payload_bytes"))
    equals = stage(first_of_equals(pages, key, payload, least_bytes), "equal-payloads")
    first = F.col("__first")
    revisit = (F.col("payload_bytes") >= least_bytes) & first.isNotNull() & ~F.col("record_key").eqNullSafe(first)
    data = F.col("__text").cast("binary")
    chunks = F.when(F.col("revisit"), F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes).cast("int"))
    )
    # equal payloads may be a third of all rows: this join is one that AQE splits
    return (
        rows.join(equals, "__digest", "left")
        .withColumn("revisit", F.coalesce(revisit, F.lit(False)))
        .withColumn("chunks", chunks)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "record_key",
            "url",
            "chunk_no",
            "chunks",
            "payload_bytes",
            F.col("__digest").alias("payload_digest"),
            "revisit",
            F.when(F.col("revisit"), first).alias("refers_to"),
            F.when(~F.col("revisit"), F.substring(data, F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).alias("data"),
        )
    )


def _record_id(key) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'record:{key}')}>"


_URL_SIGNS = ":/?#[]@!$&'()*+,;=~"


def _target(url: str | None) -> list[str]:
    """A URL as it is; one with other signs than URLs have is escaped, which a line of its own says."""
    if url is None:
        return []
    if quote(url, safe=_URL_SIGNS + "%") == url:
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {quote(url, safe=_URL_SIGNS)}", "WARC-Target-URI-Escaped: percent"]


def _header(row: dict) -> tuple[bytes, bytes]:
    """WARC header lines and the HTTP header that begins the block."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    key, refers, url = row["record_key"], row["refers_to"], row["url"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if row['revisit'] else 'response'}",
        f"WARC-Record-ID: {_record_id(key)}",
        *([] if key is None else [f"WARC-Identified-Payload-Key: {key}"]),
        *_target(url),
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["revisit"]:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers)}",
            f"WARC-Refers-To-Key: {refers}",
        ]
    block = len(http) + (0 if row["revisit"] else row["payload_bytes"])
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n").encode(), http


def write_archives(
    chunks: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, level: int = 1
) -> DataFrame:
    """Write chunk rows as archives below ``folder``; the manifest of segments, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        name = f"{path}/{uuid4().hex}.warc.gz"
        out, squeeze, offset, begun, records = None, None, 0, 0, 0
        segments: list[tuple[str, int, int, int]] = []
        try:
            for batch in batches:
                names = [n for n in batch.schema.names if n != "data"]
                meta = batch.select(names).to_pylist()
                data = batch.column(batch.schema.get_field_index("data"))
                for i, row in enumerate(meta):
                    out = out or system.open_output_stream(name, compression=None)
                    if row["chunk_no"] == 0:
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        for part in _header(row):
                            offset += out.write(squeeze.compress(part))
                    if not row["revisit"]:
                        offset += out.write(squeeze.compress(data[i].as_buffer()))
                    if row["chunk_no"] == row["chunks"] - 1:
                        offset += out.write(squeeze.compress(b"\r\n\r\n"))
                        offset += out.write(squeeze.flush())
                        records += 1
                        if offset - begun >= segment_bytes:
                            segments.append((name, begun, offset - begun, records))
                            begun, records = offset, 0
        finally:
            if out:
                out.close()
        if records:
            segments.append((name, begun, offset - begun, records))
        if segments:
            columns = list(zip(*segments, strict=True))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "start", "bytes", "records"]
            )

    return stage(chunks.mapInArrow(run, "path string, start long, bytes long, records long"), "archives")


def _records(stream, size: int) -> Iterator[tuple[dict[str, str], dict[str, str], Iterator[bytes]]]:
    """WARC and HTTP headers of the records in ``size`` bytes, with a reader of the payload.

    The payload must be read to its end before the next record is asked for.
    """
    left = size
    squeezed = b""

    def fill(inflate, need: int) -> bytes:
        nonlocal left, squeezed
        if not squeezed and left:
            squeezed = stream.read(min(left, 1 << 16))
            left -= len(squeezed)
        if inflate.eof:
            raise ValueError("a record is shorter than its headers say")
        had = bool(squeezed)
        got = inflate.decompress(squeezed, need)
        squeezed = inflate.unconsumed_tail or inflate.unused_data
        if not had and not got and not inflate.eof:
            raise ValueError("the archive ends within a record")
        return got

    while squeezed or left:
        inflate = zlib.decompressobj(31)
        held = b""
        while b"\r\n\r\n" not in held:
            held += fill(inflate, 1 << 14)
        head, held = held.split(b"\r\n\r\n", 1)
        warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        while b"\r\n\r\n" not in held:
            held += fill(inflate, 1 << 14)
        head, held = held.split(b"\r\n\r\n", 1)
        http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        todo = int(warc["Content-Length"]) - len(head) - 4

        def payload(held=held, todo=todo, inflate=inflate) -> Iterator[bytes]:
            while todo > 0:
                part = held[:todo] or fill(inflate, min(todo, CHUNK_BYTES))
                held = held[len(part) :]
                todo -= len(part)
                yield part
            while not inflate.eof:
                fill(inflate, 1 << 14)

        yield warc, http, payload()


def _url_of(warc: dict[str, str]) -> str | None:
    url = warc.get("WARC-Target-URI")
    return unquote(url) if url and "WARC-Target-URI-Escaped" in warc else url


CHUNK_SCHEMA = (
    "record_id string, record_key string, url string, record_type string, refers_to string, "
    "payload_bytes long, payload_digest string, chunk_no long, last boolean, bytes_so_far long, "
    "digest_so_far string, data binary"
)


def read_chunks(spark: SparkSession, manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """Chunk rows of all records of the archives in ``manifest``.

    ``bytes_so_far`` and ``digest_so_far`` are of the payload up to the chunk's end; without
    ``data`` only a record's last row is emitted and holds no bytes, for reading digests.
    A revisit has one row without bytes; its length and digest are from its headers.
    """
    # a segment is a task: their number is known, they are dealt by name
    segments = max(1, manifest.count())
    dealt = manifest.select("path", "start", "bytes").repartitionByRange(segments, "path", "start")
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def block() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for segment in batch.to_pylist():
                system, path = _file_system(segment["path"])
                with system.open_input_file(path) as file:
                    file.seek(segment["start"])
                    for warc, http, payload in _records(file, segment["bytes"]):
                        digest, number, so_far, part = hashlib.sha256(), 0, 0, bytearray()
                        kind = warc["WARC-Type"]
                        about = (
                            warc["WARC-Record-ID"], warc.get("WARC-Identified-Payload-Key"),
                            _url_of(warc), kind, warc.get("WARC-Refers-To-Key"),
                            int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:"),
                        )
                        for piece in payload:
                            if not data:
                                digest.update(piece)
                                so_far += len(piece)
                                continue
                            part += piece
                            while len(part) > chunk_bytes:  # the last chunk waits for the end
                                chunk = bytes(part[:chunk_bytes])
                                del part[:chunk_bytes]
                                digest.update(chunk)
                                so_far += chunk_bytes
                                rows.append((*about, number, False, so_far, digest.copy().hexdigest(), chunk))
                                held += chunk_bytes
                                number += 1
                            if held >= FLUSH_BYTES:
                                yield block()
                                rows, held = [], 0
                        digest.update(part)
                        so_far += len(part)
                        revisit = kind == "revisit"
                        rows.append((
                            *about, number, True, so_far, None if revisit else digest.hexdigest(),
                            bytes(part) if data and not revisit else None,
                        ))
                        held += len(part) + 200
                        if held >= FLUSH_BYTES:
                            yield block()
                            rows, held = [], 0
        if rows:
            yield block()

    return dealt.mapInArrow(run, CHUNK_SCHEMA)


def new_folder(spark: SparkSession) -> str:
    return shared_path(spark, "warc")
