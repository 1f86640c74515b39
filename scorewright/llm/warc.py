"""WARC archives: writing them as one gzip stream each, and the normaliser that makes their records seekable.

A monolithic archive is one gzip stream, which can only be read from its beginning. The normaliser inflates each once, as a
stream, writes every record again as a gzip member of its own, and beside the archive an index of the members' offsets.
Records are then read by seeking.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import Shelf, delete, materialize, placed, scratch, shelve

#: Bytes of records after which a task begins another archive; bytes inflated at a time.
ARCHIVE_BYTES, CHUNK = 32_000_000, 1 << 20
#: Bytes of members that a reading task gets, about; tasks of a step at most.
READ_BYTES, MOST_TASKS = 16_000_000, 20_000
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 0
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """A WARC record: its header fields and its block."""

    fields: dict[str, str]
    block: bytes

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in {**self.fields, "Content-Length": str(len(self.block))}.items())
        return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"

    @classmethod
    def read(cls, head: bytes, block: bytes) -> Record:
        lines = head.decode().split("\r\n")[1:]
        return cls(dict(line.split(": ", 1) for line in lines if line), block)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Record:
    """A response with the payload, or a revisit of another page's response; either keeps the HTTP header."""
    name = lambda x: f"<urn:x-page:{'null' if x is None else x}>"
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": _DATE,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": _PROFILE}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return Record(fields, http + (payload if refers_to is None else b""))


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file, member after member, a chunk at a time."""
    inflate = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield inflate.decompress(data, CHUNK)
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate = inflate.unused_data, zlib.decompressobj(31)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record in a stream of chunks; holds one record and one chunk."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("a record's header has no end")
        head = bytes(held[: end + 2])
        length = next(int(line[15:]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        if not fill(end + 4 + length + 4):
            raise ValueError("a record's block has no end")
        block = bytes(held[end + 4 : end + 4 + length])
        del held[: end + 4 + length + 4]
        yield head, block


class _Output:
    """A file under a URL that appears when it is complete."""

    def __init__(self, where: str, name: str):
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(where)
        self.system.create_dir(self.path, recursive=True)
        self.name, self.at = name, 0
        self.attempt = f"{self.path}/.{name}.{TaskContext.get().taskAttemptId()}"
        self.file = self.system.open_output_stream(self.attempt, compression=None)

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.file.close()
        self.system.move(self.attempt, f"{self.path}/{self.name}")


def write_archives(pages: DataFrame, revisits: str, where: str) -> DataFrame:
    """Writes pages (page_id, url, html, file__, row__) as monolithic .warc.gz files, those shelved at revisits as such;
    returns (archive, n_records). A task writes what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, done = TaskContext.get().partitionId(), 0, None, []
        held = Shelf(revisits, "first")
        size = n = 0

        def close() -> None:
            out.write(squeeze.flush())
            out.close()
            done.append((out.name, n))

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, file, row = (c[k].as_py() for c in batch.columns)
                rows, first = held.of(file)
                at = int(rows.searchsorted(row))
                refers_to = first[at].as_py() if at < len(rows) and rows[at] == row else None
                if out is None:
                    out, squeeze, size, n = _Output(where, f"part-{part:06d}-{number:04d}.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    number += 1
                data = page_record(page_id, url, (html or "").encode(), refers_to).to_bytes()
                out.write(squeeze.compress(data))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["archive", "n_records"])

    return pages.select("page_id", "url", "html", "file__", "row__").mapInArrow(run, "archive string, n_records long")


def normalize(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each archive of `source` in `target` with a gzip member per record, and beside it <archive>.idx: a JSON line
    with record id, type, offset and length of each member. Returns that index: (archive, record_id, type, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(source)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                out, index = _Output(target, archive), []
                with system.open_input_stream(f"{path}/{archive}", compression=None) as f:
                    for head, block in records(inflated(f)):
                        record, start = Record.read(head, block), out.at
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(squeeze.compress(record.to_bytes()) + squeeze.flush())
                        index.append({"record_id": record.fields["WARC-Record-ID"], "type": record.fields["WARC-Type"], "offset": start, "length": out.at - start})
                out.close()
                side = _Output(target, f"{archive}.idx")
                side.write("".join(json.dumps(x) + "\n" for x in index).encode())
                side.close()
                names, kinds = ("record_id", "type", "offset", "length"), (pa.string(), pa.string(), pa.int64(), pa.int64())
                columns = [pa.array([x[c] for x in index], kind) for c, kind in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(index), pa.string()), *columns], names=["archive", *names])

    # an archive per task: each must be read from its beginning; ranges of names, as hashes would put some together
    tasks = min(MOST_TASKS, max(1, archives.count()))
    return archives.select("archive").repartitionByRange(tasks, "archive").mapInArrow(run, "archive string, record_id string, type string, offset long, length long")


def read_records(index: DataFrame, where: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of the members that index lists."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def page(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(number) if number not in ("", "null") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(where)
        name, file = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part, rows = batch.slice(k, 200), []
                for archive, offset, length in zip(*(c.to_pylist() for c in part.columns)):
                    if archive != name:
                        name, file = archive, system.open_input_file(f"{path}/{archive}")
                    file.seek(offset)
                    head, block = next(records(iter([zlib.decompress(file.read(length), 31)])))
                    fields = Record.read(head, block).fields
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = fields["WARC-Type"] == "revisit"
                    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:]) if revisit else len(payload)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else payload_digest(payload)
                    rows.append((page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To")), None if revisit else payload))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(MOST_TASKS, max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // READ_BYTES))
    return index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").mapInArrow(run, schema)


def revisits(pages: DataFrame) -> DataFrame:
    """(file__, row__, first) of the pages (page_id, html, file__, row__) that revisit another: first is the least page_id with
    the same payload.

    Payloads are equal if length, SHA-1 and a second hash are. Rows that repeat the least page_id are all responses; a null
    page_id comes after all others, and pages that only have null ids are all responses. No payload is shuffled, only its
    digests; payloads that occur once are dropped before the join.
    """
    html = F.coalesce("html", F.lit(""))
    keys = pages.select("page_id", F.unhex(F.sha1(html)).alias("sha"), F.xxhash64(html).alias("other"), F.octet_length(html).alias("size"), "file__", "row__")
    keys = materialize(keys.filter(F.col("size") >= LEAST_REVISIT_BYTES), "digests")
    first = keys.groupBy("sha", "other", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    return keys.join(first, ["sha", "other", "size"]).filter("NOT first <=> page_id").select("file__", "row__", "first")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages (page_id, url, html; null html is an empty payload) as monolithic archives in the shared folder,
    normalises them and reads the result back; the contract's rows. Other columns are ignored, also with names of the result's."""
    spark = pages.sparkSession
    raw, final = scratch(spark, "warc-raw"), scratch(spark, "warc")
    pages = placed(pages.select("page_id", "url", "html") if set(pages.columns) & {"file__", "row__"} else pages)
    archives = materialize(write_archives(pages, shelve(revisits(pages), "revisits"), raw), "warc-archives")
    index = materialize(normalize(archives, raw, final), "warc-index")
    delete(spark, raw)
    return read_records(index, final).drop("payload")


def round_trip_sql() -> str:
    """DuckDB SQL for archive_round_trip over the table pages."""
    value = "(instr('0123456789abcdef', {}) - 1)"
    nibble = lambda k: value.format(f"substr(h, {k}, 1)")
    digits = []
    for g in range(8):  # five hexadecimal digits are four of base 32
        number = " + ".join(f"{nibble(5 * g + j + 1)} * {16 ** (4 - j)}" for j in range(5))
        digits += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({number}) // {32 ** (3 - j)}) % 32)::int + 1, 1)" for j in range(4)]
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::bigint AS payload_bytes, {" || ".join(digits)} AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
