"""WARC archives with a two-level capture index.

Writing: payloads are digested once; of records with equal payloads of at least
``least_bytes`` bytes the one with the smallest page id is a response and the others
revisit it (identical-payload-digest profile). Every task writes its own gzip-per-record
archive into the shared folder and returns where each record lies; that table, not a
directory listing, says which archives count, so repeated task attempts do no harm.

Index: capture lines are range-sorted by (reversed-host url key, page id) and written
as index parts: compressed blocks of a fixed number of lines, followed by a sparse
directory with each block's first key, offset and length. A lookup binary-searches the
list of parts (one entry per part), then one part's directory, then reads one block by
its byte range, and finally the records themselves by range, in archive order.

Defined cases: null html is the empty payload; null urls have the empty key and no
target header; rows with null page ids get a record each, never serve as the original
of a revisit and read back with null ids; repeated rows with the smallest id are all
responses; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, saved, shuffle_partitions, sliced, work_folder

CRLF = b"\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: File system schemes that Arrow knows by another name.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}
#: A digest meets its copies in this many places, so one very common payload is no hot key.
SALTS = 16

CAPTURE_SCHEMA = "page_id long, url_key string, record_type string, archive string, offset long, length long"
PART_SCHEMA = "part string, first_key string, directory_offset long, directory_length long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder that all executors share.

    Hadoop's names of object stores (s3a, s3n, abfss) are read as Arrow's own.
    """
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}://{rest}")


def url_key(url: str = "url") -> Column:
    """Reversed-host key: ``org,example,www)/path?query`` in lower case, without fragment."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(url), F.lit(""))), r"[\x00-\x20]", "_")
    rest = F.regexp_replace(plain, r"(?s)^[^/?#]*?://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^[^@]*@|:\d+$", "")
    tail = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    return F.when(rest == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail))


def record_id(page_id: int | None) -> str:
    """A urn that carries the page id; null ids get a form of their own."""
    number = (1 << 64) if page_id is None else page_id % (1 << 64)
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(identifier: bytes) -> int | None:
    number = uuid.UUID(identifier.decode().strip("<>").removeprefix("urn:uuid:")).int
    if number >= 1 << 64:
        return None
    return number - (1 << 64) if number >= 1 << 63 else number


def render(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One uncompressed record: a response, or a revisit of page ``first``."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if first is None else "revisit"
    block = http + payload if first is None else http
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if first is not None:
        lines += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF * 2


def _headers(part: bytes) -> dict[str, bytes]:
    pairs = (line.partition(b":") for line in part.split(CRLF)[1:])
    return {name.strip().lower().decode(): value.strip() for name, _, value in pairs}


def parse(record: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload), digest verified."""
    head, _, rest = record.partition(CRLF * 2)
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(CRLF * 2)
    digest = fields["warc-payload-digest"].decode().removeprefix("sha1:")
    kind = fields["warc-type"].decode()
    page = page_of(fields["warc-record-id"])
    if kind == "revisit":
        return page, int(_headers(http)["content-length"]), digest, kind, page_of(fields["warc-refers-to"]), None
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of page {page} does not match its digest")
    return page, len(payload), digest, kind, None, payload


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 4, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html); returns the captures."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", url_key().alias("url_key"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # One row per payload that occurs more than once; nulls never count as smallest.
    repeated = (
        rows.where(F.length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    # Spark broadcasts this table only while it is small; beyond that the join is by (digest, salt).
    repeated = saved(spark, repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), f"{folder}/repeated")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("salt", salt).join(repeated, ["digest", "salt"], "left")
    first = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    rows = rows.select("page_id", "url", "url_key", "payload", first.alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(f"{folder}/archives")
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, name, at, count = None, "", 0, 0
        for batch in sliced(batches):
            found = []
            for page_id, url, key, body, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{count:04d}.warc.gz"
                    out, at, count = fs.open_output_stream(f"{root}/{name}", compression=None), 0, count + 1
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(render(page_id, url, body, original)) + pack.flush()
                out.write(member)
                found.append((page_id, key, "response" if original is None else "revisit", name, at, len(member)))
                at += len(member)
            names = [f.split()[0] for f in CAPTURE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema=_arrow(CAPTURE_SCHEMA))
        if out is not None:
            out.close()

    return saved(spark, rows.mapInArrow(lean("warc", write), CAPTURE_SCHEMA), f"{folder}/captures")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _line_key(key: str, page_id: int | None) -> str:
    """Sort key of an index line; ids as fixed-width text so that lines sort as rows do."""
    return f"{key} {'' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def write_index(spark: SparkSession, captures: DataFrame, folder: str, block_lines: int = 1000) -> DataFrame:
    """Sorted, block-compressed index parts; returns one row per part."""
    sort_key = F.concat("url_key", F.lit(" "), F.coalesce(F.lpad((F.col("page_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0"), F.lit("")))
    ordered = captures.withColumn("k", sort_key)
    ordered = ordered.repartitionByRange(shuffle_partitions(spark), "k", "archive", "offset").sortWithinPartitions("k", "archive", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(f"{folder}/index")
        out, name, at, first_key = None, "", 0, ""
        directory: list[tuple[str, int, int]] = []
        lines: list[str] = []

        def close_block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            directory.append((lines[0].rsplit("\t", 3)[0], at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("k", "archive", "offset", "length")]
            for key, archive, offset, length in zip(*columns, strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    task = TaskContext.get()
                    name, first_key = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.idx", key
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(f"{key}\t{archive}\t{offset}\t{length}")
                if len(lines) >= block_lines:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            data = zlib.compress("\n".join(f"{k}\t{o}\t{n}" for k, o, n in directory).encode())
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": name, "first_key": first_key, "directory_offset": at, "directory_length": len(data)}], schema=_arrow(PART_SCHEMA))

    return saved(spark, ordered.mapInArrow(write, PART_SCHEMA), f"{folder}/parts")


class IndexReader:
    """Binary search over parts, directories and blocks, with a few of each remembered."""

    def __init__(self, folder: str, parts: list[tuple[str, str, int, int]], remembered: int = 8):
        self.folder, self.remembered = folder, remembered
        self.parts = sorted(parts, key=lambda p: p[1])
        self.firsts = [p[1] for p in self.parts]
        self.known: OrderedDict[tuple, list] = OrderedDict()

    def _range(self, part: str, offset: int, length: int) -> list[list[str]]:
        key = (part, offset)
        if key not in self.known:
            fs, root = filesystem(f"{self.folder}/index")
            with fs.open_input_file(f"{root}/{part}") as file:
                data = file.read_at(length, offset)
            self.known[key] = [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]
            if len(self.known) > self.remembered:
                self.known.popitem(last=False)
        self.known.move_to_end(key)
        return self.known[key]

    def _blocks_from(self, key: str) -> Iterator[list[list[str]]]:
        """Blocks that may hold ``key``, first to last."""
        p = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while p < len(self.parts) and (self.firsts[p] <= key or self.firsts[p].startswith(key)):
            part, _, offset, length = self.parts[p]
            directory = self._range(part, offset, length)
            b = max(0, bisect.bisect_left(directory, key, key=lambda entry: entry[0]) - 1)
            while b < len(directory) and (directory[b][0] <= key or directory[b][0].startswith(key)):
                yield self._range(part, int(directory[b][1]), int(directory[b][2]))
                b += 1
            p += 1

    def find(self, prefix: str) -> Iterator[tuple[str, int, int]]:
        """(archive, offset, length) of every line whose key starts with ``prefix``."""
        for block in self._blocks_from(prefix):
            i = bisect.bisect_left(block, prefix, key=lambda line: line[0])
            while i < len(block) and block[i][0].startswith(prefix):
                yield block[i][1], int(block[i][2]), int(block[i][3])
                i += 1


def lookup(spark: SparkSession, wanted: DataFrame, parts: DataFrame, folder: str, whole_key: bool = False) -> DataFrame:
    """Places of the captures of ``wanted`` (url_key, and page_id if ``whole_key``).

    Keys are sorted first, so a task walks through neighbouring blocks once. The list of
    parts is collected: it has one entry per index partition, however many captures.
    """
    listed = [tuple(r) for r in parts.collect()]
    order = ("url_key", "page_id") if whole_key else ("url_key",)
    ordered = wanted.select(*order).distinct().repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, listed)
        schema, found = _arrow("archive string, offset long, length long"), []
        for batch in batches:
            keys = batch.column("url_key").to_pylist()
            ids = batch.column("page_id").to_pylist() if whole_key else keys
            for key, page_id in zip(keys, ids, strict=True):
                for archive, offset, length in reader.find(_line_key(key, page_id) if whole_key and page_id is not None else f"{key} "):
                    found.append({"archive": archive, "offset": offset, "length": length})
                    if len(found) >= 20_000:  # one key may have any number of captures
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
        yield pa.RecordBatch.from_pylist(found, schema=schema)

    return ordered.mapInArrow(search, "archive string, offset long, length long")


def read_records(spark: SparkSession, places: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Parsed records at ``places``, read by range in archive order.

    With ``payloads`` responses carry their payload (revisits: null).
    """
    schema = RECORD_SCHEMA + (", payload binary" if payloads else "")
    ordered = places.repartitionByRange(shuffle_partitions(spark), "archive", "offset").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(f"{folder}/archives")
        names = [f.split()[0] for f in schema.split(", ")]
        name, file = None, None
        for batch in sliced(batches):
            rows = []
            for archive, offset, lengths in _spans(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True)):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{root}/{archive}")
                data, at = file.read_at(sum(lengths), offset), 0
                for length in lengths:
                    rows.append(dict(zip(names, parse(zlib.decompress(data[at : at + length], 31)), strict=False)))
                    at += length
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))
        if file is not None:
            file.close()

    return ordered.mapInArrow(lean("warc", read), schema)


def _spans(places: Iterator[tuple[str, int, int]], most: int = 8 << 20) -> Iterator[tuple[str, int, list[int]]]:
    """Neighbouring records as one range each: (archive, offset, record lengths)."""
    archive, start, lengths = None, 0, []
    for name, offset, length in places:
        if lengths and name == archive and offset == start + sum(lengths) and sum(lengths) < most:
            lengths.append(length)
            continue
        if lengths:
            yield archive, start, lengths
        archive, start, lengths = name, offset, [length]
    if lengths:
        yield archive, start, lengths


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = work_folder(spark, "warc")
    captures = write_archives(spark, pages, folder)
    parts = write_index(spark, captures, folder)
    # Null ids share the key's own prefix, so they are looked up without an id.
    places = lookup(spark, captures.select("url_key", "page_id"), parts, folder, whole_key=True).distinct()
    return read_records(spark, places, folder)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM p GROUP BY s)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(p.s, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (s)
"""
