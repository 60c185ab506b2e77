"""Web archives (WARC 1.1) as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading. Files are planned into partitions by size: small ones share a partition, a file is never cut, since a payload may
hold what looks like a record. Filters on the record type and other header fields are pushed down: a record's header is
parsed first, and if it fails, its block is stepped over. Uncompressed records are skipped by their length; compressed ones
(one gzip member each) by the lengths in the member's `sl` extra field, or inflated without being kept where a member has
none. The payload is decoded only if the frame's schema has it or `verify` asks for it, so
`.schema("record_type string, target_uri string")` is the pruned read.

Writing. Each task writes files of `fileBytes` or little more, each opened by a warcinfo record. Files get their final names
at once; the driver then writes a list of those of successful attempts, and readers go by such lists where there are any. So
half a file of a lost executor is never read, and nothing has to be renamed. Folders without lists are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from fieldloom.llm.places import opened, qualified
from fieldloom.session import materialize

#: Columns read from a record's own header, with the fixed names of its fields.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type", "content_length": "Content-Length",
}
NUMBERS = ("content_length", "payload_bytes")
SCHEMA = ", ".join(f"{c} {'long' if c in NUMBERS else 'string'}" for c in FIELDS) + ", payload_bytes long, payload binary"
#: Fixed values.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RECORD, INFO_RECORD = "application/http; msgtype=response", "application/warc-fields"
GZIP, EXTRA = b"\x1f\x8b\x08", 4
#: Bytes read at once, and the longest header.
READ_BYTES, HEADER_BYTES = 1 << 16, 1 << 20
#: Files up to so many bytes share a partition: the size that gives every core one, but from the first to the second number.
LEAST_BYTES, PARTITION_BYTES = 4 << 20, 128 << 20
#: Bytes after which a writer begins the next file.
FILE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
LEVEL = 6


# ---- reading ----


class Plain:
    """A record as it lies in the file: `head` reads a header, `block` what follows, `end` is where the next record starts."""

    def __init__(self, source, at: int):
        self.source, self.start, self.at, self.held, self.block_at = source, at, at, b"", None

    def pull(self, size: int) -> bytes:
        """Some more of the record, about `size` bytes."""
        got = self.source.read_at(size, self.at)
        if not got:
            raise ValueError(f"the record at {self.start} is cut off")
        self.at += len(got)
        return got

    def head(self) -> bytes:
        """All up to the next blank line."""
        seen = 0
        while (stop := self.held.find(END, max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > HEADER_BYTES:
                raise ValueError(f"no end of a header in the record at {self.start}")
            self.held += self.pull(READ_BYTES)
        head, self.held = self.held[:stop], self.held[stop + len(END) :]
        if self.block_at is None:
            self.block_at = self.at - len(self.held)
        return head

    def block(self, size: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < size:
            parts.append(self.pull(max(READ_BYTES, size - have)))
            have += len(parts[-1])
        content = b"".join(parts)
        self.held = content[size:]
        return content[:size]

    def end(self, content_length: int) -> int:
        return self.block_at + content_length + len(END)


class Member(Plain):
    """The same for a record in a gzip member of its own; only what is asked for is inflated."""

    def __init__(self, source, at: int):
        super().__init__(source, at)
        self.inflate, self.size = zlib.decompressobj(31), None
        fixed = source.read_at(24, at)
        if len(fixed) == 24 and fixed[3] & EXTRA and fixed[12:16] == b"sl\x08\x00":
            self.size = struct.unpack("<I", fixed[16:20])[0]

    def inflated(self) -> bytes:
        """What comes next of the member, perhaps nothing yet."""
        packed = self.inflate.unconsumed_tail
        if not packed:
            packed = self.source.read_at(READ_BYTES if self.size is None else min(READ_BYTES, self.start + self.size - self.at), self.at)
            self.at += len(packed)
        got = self.inflate.decompress(packed, READ_BYTES)
        if not packed and not got:
            raise ValueError(f"the record at {self.start} is cut off")
        return got

    def pull(self, size: int) -> bytes:
        while not self.inflate.eof:
            if got := self.inflated():
                return got
        raise ValueError(f"the record at {self.start} is cut off")

    def end(self, content_length: int) -> int:
        if self.size is not None:
            return self.start + self.size
        while not self.inflate.eof:
            self.inflated()
        return self.at - len(self.inflate.unused_data)


def parsed(head: bytes) -> dict[str, str]:
    """The fields of a header by lower-case name; of a repeated field the last counts."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def columns_of(fields: dict[str, str]) -> dict[str, str | int | None]:
    found = {c: fields.get(name.lower()) for c, name in FIELDS.items()}
    found["content_length"] = int(found["content_length"] or 0)
    if found["payload_digest"]:
        found["payload_digest"] = found["payload_digest"].removeprefix("sha1:")
    return found


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(source, size: int, wanted, payloads: bool, lengths: bool, verify: bool, counts: dict | None = None) -> Iterator[dict]:
    """The wanted records of a file. `counts` is told how many headers were parsed and how many payloads decoded."""
    at = 0
    while at < size:
        record = (Member if source.read_at(3, at) == GZIP else Plain)(source, at)
        head = record.head()
        if not head.lstrip(b"\r\n").startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        found = columns_of(parsed(head.lstrip(b"\r\n")))
        if counts is not None:
            counts["headers"] = counts.get("headers", 0) + 1
        if wanted(found):
            left = found["content_length"]
            found["payload_bytes"], found["payload"] = None, None
            http = (found["content_type"] or "").startswith("application/http")
            if payloads or lengths or verify:
                whole = left
                if http:
                    inner = record.head()
                    left -= len(inner) + len(END)
                    whole = int(parsed(inner).get("content-length", left))
                found["payload_bytes"] = whole
                if (payloads or verify) and found["record_type"] != "revisit":
                    payload = record.block(left)
                    if counts is not None:
                        counts["payloads"] = counts.get("payloads", 0) + 1
                    if verify and found["payload_digest"] and (digest_of(payload) != found["payload_digest"] or len(payload) != whole):
                        raise ValueError(f"the payload of {found['record_id']} is damaged")
                    found["payload"] = payload if payloads else None
            yield found
        at = record.end(found["content_length"])


#: Tests of a header's value for each kind of filter, besides those on nulls.
TESTS = {
    EqualTo: lambda v, x: v == x, EqualNullSafe: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v, GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
}


def holds(one: Filter, found: dict) -> bool | None:
    """Whether a record's header fulfils a filter; None, as in SQL, where that is not known."""
    if isinstance(one, Not):
        inner = holds(one.child, found)
        return None if inner is None else not inner
    value = found[one.attribute[0]]
    if isinstance(one, IsNull | IsNotNull):
        return (value is None) == isinstance(one, IsNull)
    if isinstance(one, EqualNullSafe):
        return value == one.value
    return None if value is None else TESTS[type(one)](value, one.value)


def on_header(one: Filter) -> bool:
    if isinstance(one, Not):
        return on_header(one.child)
    if not isinstance(one, (*TESTS, IsNull, IsNotNull)) or len(one.attribute) != 1 or one.attribute[0] not in FIELDS:
        return False
    # A list with a null never fails for sure; Spark evaluates it.
    return not (isinstance(one, In) and None in one.value)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


def listed(folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of the archives of a folder, or of one file; of those written here only the committed ones."""
    files, path = opened(folder)
    info = files.get_file_info(path)
    if info.type == arrow_fs.FileType.File:
        return [(path, info.size)]
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = files.get_file_info(arrow_fs.FileSelector(path, recursive=True))
    lists = [f.path for f in found if f.base_name.startswith("_committed-")]
    archives = [f for f in found if f.type == arrow_fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]
    if lists:
        names = set()
        for one in lists:
            with files.open_input_file(one) as source:
                names.update(json.loads(source.read()))
        archives = [f for f in archives if f.base_name in names]
        if len(archives) < len(names):
            raise ValueError(f"{len(names) - len(archives)} committed files are missing in {folder}")
    return sorted((f.path, f.size) for f in archives)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.columns = {f.name: f.dataType.simpleString() for f in schema}
        unknown = set(self.columns) - {*FIELDS, "payload_bytes", "payload"}
        if unknown:
            raise ValueError(f"no such columns in an archive: {', '.join(sorted(unknown))}")
        self.folder, self.verify = options["path"], options.get("verify", "false").lower() == "true"
        self.partition_bytes, self.tasks = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("tasks", 1))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if on_header(one):
                self.filters.append(one)
            else:
                yield one

    def partitions(self) -> list[Files]:
        planned, held, found = [], 0, listed(self.folder)
        most = min(self.partition_bytes, max(LEAST_BYTES, sum(s for _, s in found) // self.tasks))
        for path, size in found:
            if not planned or held + size > most:
                planned.append(Files([]))
                held = 0
            planned[-1].paths.append((path, size))
            held += size
        return planned

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c, kinds[t]) for c, t in self.columns.items()])
        files, _ = opened(self.folder)
        rows, weight = [], 0
        for path, size in partition.paths if partition is not None else []:
            with files.open_input_file(path) as source:
                wanted = lambda found: all(holds(f, found) for f in self.filters)
                for row in records(source, size, wanted, "payload" in self.columns, "payload_bytes" in self.columns, self.verify):
                    rows.append({c: row[c] for c in self.columns} if self.columns else {})
                    weight += 256 + len(row["payload"] or b"")
                    if weight >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, weight = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)


# ---- writing ----


def member(content: bytes) -> bytes:
    """One gzip member that tells its lengths, unless they pass 4 GB."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(content) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)
    size = 24 + len(body) + 8
    if size >= 1 << 32 or len(content) >= 1 << 32:
        return GZIP + struct.pack("<BIBB", 0, 0, 0, 255) + body + tail
    return GZIP + struct.pack("<BIBB", EXTRA, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size, len(content)) + body + tail


def one_line(value: str) -> str:
    """A header's value: line ends and other control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value).strip()


def record_bytes(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = "".join(f"{FIELDS[c]}: {one_line(v)}\r\n" for c, v in fields.items() if v is not None)
    if fields["record_type"] == "revisit":
        lines += f"WARC-Profile: {PROFILE}\r\n"
    return VERSION + f"{lines}Content-Length: {len(block)}".encode() + END + block + END


def http_block(size: int, payload: bytes | None) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END + (payload or b"")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_type, record_id, target_uri, refers_to, payload_digest (bytes of the SHA-1), payload_bytes, payload."""

    def __init__(self, options):
        self.folder = options["path"]
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.packed = options.get("compression", "gzip").lower() == "gzip"
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = opened(self.folder)
        files.create_dir(path, recursive=True)
        names, out = [], None
        shape = member if self.packed else bytes
        try:
            for batch in iterator:
                columns = [batch.column(n) for n in batch.schema.names]
                for values in zip(*columns, strict=True):
                    row = {n: v.as_py() for n, v in zip(batch.schema.names, values, strict=True)}
                    if out is None:
                        names.append(f"{self.job}-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                        out = files.open_output_stream(f"{path}/{names[-1]}", compression=None)
                        info = {"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "date": self.date, "content_type": INFO_RECORD}
                        out.write(shape(record_bytes(info, b"format: WARC File Format 1.1\r\n")))
                    out.write(shape(self.record(row)))
                    if out.tell() >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def record(self, row: dict) -> bytes:
        digest = "sha1:" + base64.b32encode(row["payload_digest"]).decode()
        fields = {c: row[c] for c in ("record_type", "record_id", "target_uri", "refers_to")} | {"date": self.date, "payload_digest": digest, "content_type": HTTP_RECORD}
        return record_bytes(fields, http_block(row["payload_bytes"], row["payload"]))

    def commit(self, messages: list[Written | None]) -> None:
        files, path = opened(self.folder)
        files.create_dir(path, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with files.open_output_stream(f"{path}/_committed-{self.job}", compression=None) as out:
            out.write(json.dumps(names).encode())
        self._remove(files, path, set(names))

    def abort(self, messages: list[Written | None]) -> None:
        files, path = opened(self.folder)
        self._remove(files, path, set())

    def _remove(self, files: arrow_fs.FileSystem, path: str, but: set[str]) -> None:
        """Files that lost attempts of this write have left; one that comes later is on no list."""
        for f in files.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.startswith(f"{self.job}-") and f.base_name not in but:
                files.delete_file(f.path)


class WarcSource(DataSource):
    """Options: path; reading: partitionBytes, tasks, verify; writing: fileBytes, compression (gzip or none), date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it push filters down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages ----


def page_records(pages: DataFrame, least_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", text_column: str = "html") -> DataFrame:
    """A record per page: of equal payloads of at least `least_bytes` bytes the least id is the response, others revisit it.

    Null text counts as empty and is a payload like any other. Null ids come after all others; rows that repeat both the
    least id and the payload are all responses. Equality goes by SHA-256. Only payloads that occur more than once are
    joined, by a broadcast if their written table is small enough for Spark's own limit; else hot ones are split by
    adaptive execution. Other columns are not read. Columns: record_type, record_id, target_uri, refers_to, payload_digest,
    payload_bytes, payload.
    """
    payload = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    again = rows.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("sha").alias("_sha")).agg(F.min("id").alias("_first"), F.count("*").alias("_n"))
    again = materialize(again.where("_n > 1").drop("_n").withColumn("_again", F.lit(True)), "payloads")
    revisit = F.coalesce(F.col("_again") & ~F.col("id").eqNullSafe(F.col("_first")), F.lit(False))
    return rows.join(again, F.col("sha") == F.col("_sha"), "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _urn(F.col("id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.when(revisit, _urn(F.col("_first"))).alias("refers_to"), F.unhex(F.sha1("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def page_id(urn: str) -> Column:
    """The id in a record's name, null for pages without one and for records that are no page."""
    return F.expr(f"try_cast(regexp_extract({urn}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 0, **options) -> str:
    """Write a page table as archives; the qualified folder. An empty table writes none, only an empty list."""
    spark = pages.sparkSession
    register(spark)
    place = qualified(spark, folder)
    page_records(pages, least_bytes).write.format("warc").mode("append").options(**options).save(place)
    return place


def read_archives(spark: SparkSession, folder: str, columns: str = SCHEMA, **options) -> DataFrame:
    """The records of a folder of archives. `columns` are what is decoded: without payload no payload is, but for `verify`."""
    register(spark)
    options = {"tasks": str(spark.sparkContext.defaultParallelism), **options}
    return spark.read.format("warc").schema(columns).options(**options).load(qualified(spark, folder))
