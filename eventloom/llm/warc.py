"""WARC archives as a chunked record table (operator 5).

A record is written as rows (archive, record_id, chunk_no, data): the rows' data, in the order of
the record ids and chunk numbers, are the bytes of a WARC 1.1 file. The first row of a record
holds its header block and the HTTP head of its payload; the payload follows in chunks of bounded
size, and every row carries the digest and the length that a running SHA-1 has reached, so a
reader that streams the rows checks a record without ever holding it whole. A payload beyond one
chunk is never joined again. Each archive begins with a ``warcinfo`` record. Record ids are UUIDs
of the row: key, payload digest and row number.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a
response and the others are revisits. Only (id, digest, length) rows are shuffled to decide that,
aggregated before they move. The revisits are counted: if few, their list is broadcast, so that
payloads aren't shuffled to be written; if many, the payloads meet it by a shuffle of their ids.
Archives are as many as the payloads' bytes need at ``ARCHIVE`` bytes each. Reading back shuffles
chunks by record id and sorts them within partitions; a large record lies
in many chunks but streams through one task, which holds one chunk of it at a time.

A null payload is the empty one, and empty payloads are equal to each other. Rows that share a
page_id are records of their own with that id, told apart by a row number; the same id refers to
them all, and a revisit names the first one's record. A null url gives an empty target, a null id
none. An empty table gives one archive that holds its ``warcinfo`` only. Extra columns are ignored.
A payload that arrives from Spark is one value, so the longest page bounds a task's memory when it
is written; when it is read, a chunk does.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._shared import kept

CHUNK = 64 * 1024
ARCHIVE = 1 << 30
FLUSH = 2 << 20
MOST_BROADCAST = 500_000
#: bytes_so_far and sha1_so_far: of the stored payload up to and with this chunk
TABLE = "archive int, record_id string, row_no long, chunk_no int, bytes_so_far long, sha1_so_far string, data binary"
RECORD = "record_id string, row_no long, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, stored_bytes long, intact boolean"
END = b"\r\n\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def decisions(narrow: DataFrame, least: int) -> DataFrame:
    """(_w_digest, _w_first, _w_first_row) of payloads that two or more rows share; of rows (_w_key, _w_row, _w_digest, _w_bytes)."""
    return (
        narrow.where(F.col("_w_bytes") >= least)
        .groupBy("_w_digest")
        .agg(F.min(F.struct("_w_key", "_w_row")).alias("_w_f"), F.count("*").alias("_w_n"))
        .where(F.col("_w_n") > 1)
        .select("_w_digest", F.col("_w_f._w_key").alias("_w_first"), F.col("_w_f._w_row").alias("_w_first_row"))
    )


def record_urn(record: str | None, digest: str, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record}|{digest}|{row}')}>"


def _lines(*lines: str) -> bytes:
    return "\r\n".join([*lines, "", ""]).encode()


def _one_line(value: str | None) -> str:
    return re.sub("[\r\n]", " ", value or "")


def _header(kind: str, record: str | None, row: int, url: str, digest: str, size: int, stored: int, refers: str | None, first_row: int | None, date: str) -> bytes:
    """Header block and HTTP head of a record whose payload has ``size`` bytes, of which ``stored`` follow."""
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(record, digest, row)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {_one_line(record)}", f"X-Payload-Length: {size}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: {record_urn(refers, digest, first_row)}", f"X-Refers-To-Page-ID: {_one_line(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _lines(*lines, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + stored}") + http


def _info(archive: int, date: str) -> bytes:
    body = _lines("software: eventloom", "format: WARC File Format 1.1")
    return _lines("WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_urn('warcinfo', date, archive)}", f"WARC-Date: {date}", f"WARC-Filename: archive-{archive:05d}.warc", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}") + body


def write_chunks(
    pages: DataFrame, archives: int | None = None, least: int = 0, chunk: int = CHUNK, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None
) -> DataFrame:
    """The chunked record table of ``pages`` (schema ``TABLE``), written to the shared folder; ``date`` is the
    records' WARC-Date (now)."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload), F.lit(""))
    numbered = pages.select(F.col(key).alias("_w_key"), F.coalesce(F.col(url), F.lit("")).alias("_w_url"), F.encode(body, "UTF-8").alias("_w_body"), F.monotonically_increasing_id().alias("_w_row"))
    narrow = kept(numbered.select("_w_key", "_w_row", F.sha1("_w_body").alias("_w_digest"), F.octet_length("_w_body").alias("_w_bytes")), "warc-digests")
    if archives is None:
        archives = max(1, -(-(narrow.agg(F.sum("_w_bytes")).first()[0] or 0) // ARCHIVE))
    shared = kept(decisions(narrow, least), "warc-shared")
    few = shared.count() <= MOST_BROADCAST
    rows = numbered.withColumn("_w_sha1", F.sha1("_w_body"))
    same = (F.col("_w_sha1") == F.col("_w_digest")) & (F.octet_length("_w_body") >= least)
    other = ~F.col("_w_key").eqNullSafe(F.col("_w_first"))
    typed = rows.join(F.broadcast(shared) if few else shared, same, "left").select(
        F.pmod(F.xxhash64("_w_key"), F.lit(archives)).cast("int"), F.col("_w_key").cast("string"), "_w_row", "_w_url", "_w_body",
        F.when(other, F.col("_w_first")).cast("string"), F.when(other, F.col("_w_first_row")), F.unhex("_w_sha1"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for at in range(batch.num_rows):
                archive, record, number, target, refers, first_row, sha = (batch.column(c)[at].as_py() for c in (0, 1, 2, 3, 5, 6, 7))
                body = memoryview(batch.column(4)[at].as_buffer())
                size = len(body)
                body = body if refers is None else body[:0]
                running, so_far = hashlib.sha1(), 0
                out.append((archive, record, number, 0, 0, running.hexdigest(), _header("response" if refers is None else "revisit", record, number, target, base32_sha1(sha), size, len(body), refers, first_row, date)))
                for no, start in enumerate(range(0, len(body), chunk), 1):
                    part = bytes(body[start : start + chunk])
                    running.update(part)
                    so_far += len(part)
                    held += len(part)
                    out.append((archive, record, number, no, so_far, running.hexdigest(), part))
                    if held >= FLUSH:
                        yield _table(out)
                        out, held = [], 0
                out.append((archive, record, number, -(-len(body) // chunk) + 1, so_far, running.hexdigest(), END))
                held += 900
        if out:
            yield _table(out)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha1().hexdigest()
        for batch in batches:
            yield _table([row for n in batch.column(0).to_pylist() for row in ((n, None, -1 - n, 0, 0, none, _info(n, date)), (n, None, -1 - n, 1, 0, none, END))])

    infos = pages.sparkSession.range(archives, numPartitions=max(1, archives // 10_000)).mapInArrow(opened, TABLE)
    return kept(typed.mapInArrow(run, TABLE).unionByName(infos), "warc-chunks")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    names = ["archive", "record_id", "row_no", "chunk_no", "bytes_so_far", "sha1_so_far", "data"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_records(chunks: DataFrame) -> DataFrame:
    """A row (schema ``RECORD``) for each record of a chunk table, checked while its chunks stream by.

    ``intact``: chunk numbers, running lengths and running digests agree with the data, the length
    with the header, and a response's digest with its header. A record without its header or its end
    row is returned too, not intact. Archives' ``warcinfo`` records are rows of their own, without an id.
    """
    order = ["record_id", "row_no", "chunk_no"]
    dealt = chunks.select(*order, "bytes_so_far", "sha1_so_far", "data").repartition("record_id", "row_no").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at: tuple | None = None  # the record that streams by, until its end row
        fields: dict[str, str] = {}
        block = b""  # what the first row holds of the record's block

        def close(good: bool) -> None:
            out.append((*at, fields.get("WARC-Target-URI"), fields.get("WARC-Type"), fields.get("X-Refers-To-Page-ID"), int(fields.get("X-Payload-Length", -1)), fields.get("WARC-Payload-Digest", "")[5:], size, good))

        def whole() -> bool:
            if int(fields.get("Content-Length", -1)) != len(block) + size:
                return False
            return fields["WARC-Type"] != "response" or base32_sha1(running.digest()) == fields["WARC-Payload-Digest"][5:]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            for row, (record, number, no, so_far, sha) in enumerate(zip(*columns, strict=True)):
                data = batch.column(5)[row].as_buffer()
                if (record, number) != at:
                    if at is not None:
                        close(False)  # its end row is missing
                    head, _, block = bytes(data).partition(b"\r\n\r\n") if no == 0 else (b"", b"", b"")
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
                    at, running, size, good, expected = (record, number), hashlib.sha1(), 0, no == 0, 1
                    continue
                good &= no == expected
                expected += 1
                if data.size == len(END) and bytes(data) == END and size == so_far and whole():
                    close(good)
                    at = None
                else:
                    running.update(data)
                    size += len(data)
                    good &= size == so_far and running.hexdigest() == sha
            if out:
                yield _records(out)
                out = []
        if at is not None:
            close(False)
            yield _records(out)

    return dealt.mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = ["record_id", "row_no", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "stored_bytes", "intact"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def export_files(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes archive files ``folder/archive-<n>.warc``; (archive, bytes). ``folder`` is a mount that all
    executors share; an archive is written beside its place and moved there when it is whole."""
    order = ["archive", "record_id", "row_no", "chunk_no"]
    dealt = chunks.select(*order, "data").repartition("archive").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        name, sink, sizes = None, None, {}
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(4), strict=True):
                if archive != name:
                    if sink:
                        sink.close()
                        os.replace(sink.name, f"{folder}/archive-{name:05d}.warc")
                    name = archive
                    sink = open(f"{folder}/.archive-{name:05d}.{os.getpid()}", "wb")
                sizes[name] = sizes.get(name, 0) + sink.write(data.as_buffer())
        if sink:
            sink.close()
            os.replace(sink.name, f"{folder}/archive-{name:05d}.warc")
        yield pa.RecordBatch.from_arrays([pa.array(sizes.keys(), pa.int32()), pa.array(sizes.values(), pa.int64())], names=["archive", "bytes"])

    return dealt.mapInArrow(run, "archive int, bytes long")
