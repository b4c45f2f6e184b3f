"""WARC archives with a two-level capture index.

Writing: payloads are grouped by digest; in each group the largest id is a
response and the others revisit it. Every task writes archives of its own, one
gzip member per record, and returns where each record lies; names are unique per
attempt and only rows of finished attempts enter the index, so a task that runs
twice does no harm.

Index: capture keys (reversed host, path, id) are range-partitioned and sorted
into compressed blocks; a sparse directory holds the first key of each block. A
lookup finds the part by its bounds, then the block by binary search in the
part's directory, reads that range only, and searches the block.

Reading: records are read by ranges, in file order; digests are verified.

Null pages have an empty payload; null or empty addresses get a urn of their id.
Null ids are written and read as null, and revisit or answer like others, but are
preferred last. Repeated rows are records of their own; those of the largest id
are all responses. Empty tables write nothing. Other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.shared import broadcast_if_small, checkpointed, filesystem, fresh_path
from profseek.llm.components import stored

#: An archive is closed beyond this size, a block beyond these captures.
ARCHIVE_BYTES = 256 << 20
BLOCK_CAPTURES = 2000
#: Captures of one file range are read by one task.
READ_BYTES = 4 << 20  # of an archive, read by one task in order
TASK_BYTES = 64 << 20  # of records, read by one task
PART_CAPTURES = 100_000
LEVEL = 4
NO_ID = -(1 << 63)
_CAPTURE = "surt string, page_id long, file string, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(url: str | None, page_id: int | None) -> str:
    """An address fit for a header line."""
    url = url or f"urn:pages:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def surt(url: str) -> str:
    """Sort key of an address: host labels reversed, then path and query."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url)
    if not found:
        return url.split("#")[0]
    return ",".join(reversed(found[1].lower().split("."))) + ")" + (found[2] or "/")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str, digest: str) -> bytes:
    """One record; a revisit repeats the response's head without its payload."""
    revisit = refers_to is not None
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:pages:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:pages:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("broken record")
    inner, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in inner.decode().split("\r\n")[1:]), payload


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _page(name: str) -> int | None:
    number = name[len("<urn:pages:"):-1]
    return int(number) if number else None


class _Rolling:
    """Files of bounded size in one folder, names unique to this attempt."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit = folder, suffix, limit
        self.out, self.name, self.at = None, "", 0

    def write(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            fs, base = filesystem(self.folder)
            fs.create_dir(base, recursive=True)
            self.out = fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(surt, page_id, file, offset, length) of the records written to `folder`."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    twins = rows.filter(F.octet_length("html") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    twins = stored(twins.filter((F.col("n") > 1) & F.col("holder").isNotNull()).select("digest", "holder"), "twins")
    known = rows.join(broadcast_if_small(twins), "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Rolling(folder, ".warc.gz", ARCHIVE_BYTES)
        for batch in batches:
            out = []
            for page_id, address, html, refers_to in zip(*(c for c in batch.columns)):
                page_id, body = page_id.as_py(), html.as_py().encode()
                address = target(address.as_py(), page_id)
                data = _gzip(record(page_id, address, body, refers_to.as_py(), date, base32_sha1(body)))
                name, offset = files.write(data)
                out.append((surt(address), page_id, name, offset, len(data)))
            yield _rows(out)
        files.close()

    return stored(known.mapInArrow(write, _CAPTURE), "records")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                      ["surt", "page_id", "file", "offset", "length"])


def build_index(records: DataFrame, folder: str) -> DataFrame:
    """The sparse directory (part, surt, page_id, file, offset, length) of the sorted blocks written to `folder`.

    `records` is stored; a part of the index holds about PART_CAPTURES of them.
    """
    key = F.coalesce("page_id", F.lit(NO_ID))
    n = max(records.sparkSession.sparkContext.defaultParallelism, -(-records.count() // PART_CAPTURES))
    ranged = records.withColumn("page_id", key).repartitionByRange(n, "surt", "page_id").sortWithinPartitions(
        "surt", "page_id", "file", "offset").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, part = _Rolling(folder, ".idx", ARCHIVE_BYTES), [], 0

        def flush() -> pa.RecordBatch:
            data = zlib.compress("\n".join("\t".join(map(str, r)) for r in held).encode())
            name, offset = files.write(data)
            first = held[0]
            held.clear()
            row = (part, first[0], first[1], name, offset, len(data))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row],
                                              ["part", "surt", "page_id", "file", "offset", "length"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                part = row[5]
                held.append(row[:5])
                if len(held) >= BLOCK_CAPTURES:
                    yield flush()
        if held:
            yield flush()
        files.close()

    return stored(ranged.mapInArrow(write, "part long, surt string, page_id long, file string, offset long, length long"),
                  "directory")


def lookup(directory: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """Captures (surt, page_id, file, offset, length) of the wanted distinct (surt, page_id), through the index."""
    bounds = sorted((r["first"]["surt"], r["first"]["page_id"], r["part"]) for r in directory.groupBy("part").agg(
        F.min(F.struct("surt", "page_id")).alias("first")).collect())  # one row per part of the index

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [b[:2] for b in bounds]
        for batch in batches:
            at = [max(0, bisect_right(starts, key) - 1) for key in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([bounds[k][2] if bounds else 0 for k in at], pa.int64())],
                ["surt", "page_id", "part"])

    def find(blocks: pa.Table, keys: pa.Table) -> pa.Table:
        rows = sorted(zip(*(blocks.column(c).to_pylist() for c in ("surt", "page_id", "file", "offset", "length"))))
        firsts = [r[:2] for r in rows]
        fs, base = filesystem(folder)
        out, opened, name, at, captures, places = [], None, None, -1, [], []
        for key in sorted(zip(keys.column("surt").to_pylist(), keys.column("page_id").to_pylist())):
            k = max(0, bisect_left(firsts, key) - 1)
            while k < len(rows) and firsts[k] <= key:
                if k != at:
                    if rows[k][2] != name:
                        name, opened = rows[k][2], fs.open_input_file(f"{base}/{rows[k][2]}")
                    lines = zlib.decompress(opened.read_at(rows[k][4], rows[k][3])).decode().split("\n")
                    captures = [(s, int(p), f, int(o), int(n)) for s, p, f, o, n in (x.split("\t") for x in lines)]
                    places, at = [c[:2] for c in captures], k
                out += captures[bisect_left(places, key):bisect_right(places, key)]
                k += 1
        return pa.Table.from_batches([_rows(out)])

    keyed = wanted.select("surt", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).mapInArrow(
        part_of, "surt string, page_id long, part long")
    return directory.groupBy("part").cogroup(keyed.groupBy("part")).applyInArrow(find, _CAPTURE)


def read_records(captures: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records at the given places: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]."""
    # a place is few bytes but stands for a record: tasks are dealt by the bytes of the records, not of the places
    places = checkpointed(captures.select("file", "offset", "length"))
    total = places.agg(F.sum("length")).first()[0] or 0
    n = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    near = places.repartition(n, F.col("file"), F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        opened, name = None, None
        for batch in batches:
            out = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, opened = file, fs.open_input_file(f"{base}/{file}")
                fields, http, payload = parse(zlib.decompress(opened.read_at(length, offset), 31))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = fields["WARC-Type"] == "revisit"
                size = int(http["Content-Length"])
                if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"],
                            _page(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds[:6 + with_payload])],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][:6 + with_payload])

    return near.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, "
                           "record_type string, refers_to long" + ", payload binary" * with_payload)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages, index them, look every capture up and read it back."""
    folder = fresh_path(pages.sparkSession, "warc")
    records = write_archive(pages, folder, id_col, url, payload)
    directory = build_index(records, folder)
    found = lookup(directory, records.select("surt", "page_id").distinct(), folder)
    return read_records(found, folder)
