"""WARC archives as a PySpark data source, and web pages written to them with revisit records.

Writing: each task writes files of its own, named at random, and reports them with the places where stretches of about
`split_bytes` begin; the commit writes a manifest of the files of successful tasks. What a lost or repeated task left
is not in it, so it is never read. Every record is one gzip member whose header carries the member's and the header
block's compressed sizes in an extra field, so a reader can step over a record or over its payload without inflating.

Reading: partitions are the manifest's stretches, or whole files where there is no manifest. Filters on record_type and
on the header columns are taken from the plan; a record's headers are parsed first, and its payload is inflated only
if they pass and a payload column is asked for. Plain and ordinary record-compressed WARC files are read too. A file
that is damaged or cut short raises an error that names it; no record is left out or shortened in silence.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

VERSION = b"WARC/1.1"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, content_length bigint, full_length bigint, payload binary"
#: Column and WARC header. Fixed values; the last but one is an extension of ours.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "full_length": "X-Full-Payload-Length",
    "content_length": "Content-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Each write leaves a manifest of its own, so that appends, at the same time too, never touch each other's.
MANIFEST = "_manifest"


def header_block(values: dict[str, str | None]) -> bytes:
    """The named headers of a record, CR and LF taken out of their values, and the blank line after them."""
    lines = [VERSION] + [f"{k}: {v}".replace("\r", " ").replace("\n", " ").encode() for k, v in values.items() if v is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def member(head: bytes, payload: bytes, level: int) -> bytes:
    """A gzip member of a record. Extra field "WL": sizes of the whole member, of the compressed headers, and of them inflated."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    first = z.compress(head) + z.flush(zlib.Z_FULL_FLUSH)
    body = payload + b"\r\n\r\n"
    rest = z.compress(body) + z.flush()
    size = 12 + 16 + len(first) + len(rest) + 8
    extra = b"WL" + struct.pack("<HIII", 12, size, len(first), len(head))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 16) + extra + first + rest + struct.pack("<II", zlib.crc32(body, zlib.crc32(head)), len(head) + len(body) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Damaged(ValueError):
    """A record that is cut short or whose bytes don't fit its checksum."""


class Records:
    """Records of an open file from where it stands: headers first, then payload() or the next record. A record that is
    not whole raises Damaged, also if its payload is stepped over; its checksum is looked at with the payload."""

    def __init__(self, f, stop: int | None):
        self.f, self.stop, self.inflated = f, stop, 0
        at = f.tell()
        self.size = f.seek(0, 2)
        f.seek(at)

    def whole(self, end: int, what: str) -> None:
        if end > self.size:
            raise Damaged(f"{what} ends at byte {end} of {self.size}")

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        f = self.f
        while self.stop is None or f.tell() < self.stop:
            start, lead = f.tell(), f.read(28)
            if not lead:
                return
            if lead[:2] != b"\x1f\x8b":
                f.seek(start)
                yield from self._plain()
                return
            if lead[3] & 4 and lead[12:14] == b"WL":
                self.whole(start + 28, "a member's header")
                size, first, length = struct.unpack("<III", lead[16:28])
                self.whole(start + size, f"the member at byte {start}")
                try:
                    head = zlib.decompressobj(-15).decompress(f.read(first), length)
                except zlib.error as e:
                    raise Damaged(f"the member at byte {start}: {e}") from e
                headers = parse_headers(head)

                def payload(start=start, first=first, size=size, head=head, headers=headers) -> bytes:
                    self.inflated += 1
                    f.seek(start + 28 + first)
                    try:
                        body = zlib.decompressobj(-15).decompress(f.read(size - 28 - first - 8))
                    except zlib.error as e:
                        raise Damaged(f"the member at byte {start}: {e}") from e
                    n, known = int(headers.get("content-length", 0)), struct.unpack("<II", f.read(8))
                    if known != (zlib.crc32(body, zlib.crc32(head)), len(head) + len(body) & 0xFFFFFFFF) or len(body) < n:
                        raise Damaged(f"the member at byte {start} doesn't fit its checksum or length")
                    return body[:n]

                yield headers, payload
                f.seek(start + size)
            else:
                f.seek(start)
                yield from self._members()
                return

    def _plain(self) -> Iterator:
        f = self.f
        while self.stop is None or f.tell() < self.stop:
            block = b""
            while not block.endswith(b"\r\n\r\n"):
                line = f.readline()
                if not line:
                    if block:
                        raise Damaged(f"the file ends within a record's headers at byte {self.size}")
                    return
                if block or line.strip():
                    block += line
            headers = parse_headers(block)
            at, n = f.tell(), int(headers.get("content-length", 0))
            self.whole(at + n, "a payload")

            def payload(at=at, n=n) -> bytes:
                self.inflated += 1
                f.seek(at)
                return f.read(n)

            yield headers, payload
            f.seek(at + n)

    def _members(self) -> Iterator:
        """Ordinary gzip: members follow one another and have to be inflated to find their ends."""
        left = b""
        while True:
            z, out, begun = zlib.decompressobj(31), [], False
            while not z.eof:
                if not left and not (left := self.f.read(1 << 16)):
                    if begun:
                        raise Damaged(f"the file ends within a gzip member at byte {self.size}")
                    return
                begun = True
                try:
                    out.append(z.decompress(left))
                except zlib.error as e:
                    raise Damaged(f"a gzip member before byte {self.f.tell()}: {e}") from e
                left = z.unused_data
            yield from Records(io.BytesIO(b"".join(out)), None)


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, name


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    stop: int | None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.types, self.wanted = path, schema.fieldNames(), [f.dataType.simpleString() for f in schema], {}

    def pushFilters(self, filters):
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                new = {None if v is None else str(v) for v in values} - {None}
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & new if name in self.wanted else new
            else:
                yield f

    def partitions(self):
        where, root = _open(self.path)
        info = where.get_file_info(root)
        if manifests := _manifests(where, root):
            files = []
            for path in manifests:
                with where.open_input_stream(path, compression=None) as f:
                    files += json.loads(f.read())
            return [Stretch(f"{self.path}/{x['name']}", a, b) for x in files for a, b in zip(x["at"], x["at"][1:])]
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
        base = self.path if info.type == fs.FileType.File else None
        return [Stretch(base or self.path + x.path[len(root) :], 0, None) for x in found if x.type == fs.FileType.File and ".warc" in x.base_name]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for no partitions at all
            return
        try:
            yield from self.batches(partition)
        except ValueError as e:
            raise Damaged(f"{partition.path}: {e}") from e

    def batches(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        where, name = _open(partition.path)
        columns: list[list] = [[] for _ in self.names]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        size = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, self.types, strict=True)], self.names)
            for c in columns:
                c.clear()
            return out

        with where.open_input_file(name) as raw:
            f = io.BufferedReader(raw, 1 << 20) if hasattr(raw, "readinto") else raw
            f.seek(partition.start)
            for headers, payload in Records(f, partition.stop):
                if any(headers.get(HEADERS[k].lower()) not in v for k, v in self.wanted.items()):
                    continue
                for c, n, t in zip(columns, self.names, self.types, strict=True):
                    value = payload() if n == "payload" else headers.get(HEADERS[n].lower())
                    if n == "payload":
                        size += len(value)
                    c.append(int(value) if t == "bigint" and value is not None else value)
                if size > 1 << 24 or len(columns[0]) >= 8192:
                    yield batch()
                    size = 0
        if columns and columns[0]:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    name: str
    at: list[int]


def _manifests(where: fs.FileSystem, root: str) -> list[str]:
    """The manifests of all writes to a folder, in order of their names."""
    if where.get_file_info(root).type != fs.FileType.Directory:
        return []
    found = where.get_file_info(fs.FileSelector(root))
    return sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, split_bytes: int, level: int, overwrite: bool = False):
        self.path, self.split, self.level, self.overwrite = path, split_bytes, level, overwrite
        where, root = _open(path)
        where.create_dir(root, recursive=True)

    def write(self, iterator) -> Written:
        where, root = _open(self.path)
        name, at, place = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
        # the members are compressed one by one here; by the file's name the stream would compress them all once more
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            for row in iterator:
                payload = bytes(row["payload"] or b"")
                values = {h: row[c] for c, h in HEADERS.items() if c != "content_length" and row[c] is not None}
                if row["record_type"] == "revisit":
                    values["WARC-Profile"] = PROFILE
                data = member(header_block(values | {"Content-Length": str(len(payload))}), payload, self.level)
                out.write(data)
                place += len(data)
                if place - at[-1] >= self.split:
                    at.append(place)
        return Written(name, at if at[-1] == place else [*at, place])

    def commit(self, messages) -> None:
        where, root = _open(self.path)
        before = _manifests(where, root) if self.overwrite else []
        with where.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([{"name": m.name, "at": m.at} for m in messages if m and len(m.at) > 1]).encode())
        for path in before:  # what they name is no part of the archive any more
            with where.open_input_stream(path, compression=None) as f:
                names = [x["name"] for x in json.loads(f.read())]
            where.delete_file(path)
            for name in names:
                where.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        where, root = _open(self.path)
        for m in messages:
            if m:
                where.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """Format "warc". Options: path; for writing split_bytes and level. Read with any subset of SCHEMA's columns as the
    schema: without `payload` no payload is decoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"].rstrip("/"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"].rstrip("/"), int(self.options.get("split_bytes", 8 << 20)), int(self.options.get("level", 6)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, nameless: bool = False) -> DataFrame:
    """WARC records (columns of SCHEMA) of pages: of those with equal payloads of at least `least` bytes the smallest id
    is a response and the others revisit it; smaller payloads are all responses. A null html is an empty payload. Rows
    with a null id are left out, or with `nameless` are all responses under the id <urn:page:null>; rows that share an
    id are a record each, under one record id."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.where(F.lit(nameless) | F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    keys = rows.where("_id is not null").select("_id", F.octet_length("payload").cast("long").alias("full_length"), F.sha2("payload", 256).alias("d"))
    firsts = keys.where(F.col("full_length") >= least).groupBy("d").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = keys.where(F.col("full_length") >= least).join(firsts, "d").where("_id <> first").select(F.col("_id").alias("_own"), F.col("d").alias("_d"), "first").distinct()
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")))
    out = rows.join(again, (F.col("_id") == F.col("_own")) & (F.sha2("payload", 256) == F.col("_d")), "left")
    return out.select(
        F.coalesce(name(F.col("_id")), F.lit("<urn:page:null>")).alias("record_id"),
        F.when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
        "target_uri",
        name(F.col("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("content_length"),
        F.octet_length("payload").cast("long").alias("full_length"),
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Adds records to the archive under `path`; with mode "overwrite" they replace what earlier writes left there."""
    register(records.sparkSession)
    records.write.format("warc").mode(mode).options(path=path, **options).save()


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records under `path`. Only the `columns` asked for are decoded."""
    register(spark)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(path)
