"""WARC archives: a writer that goes through Spark's own file output, and a Python data source that reads them.

Writing: each row becomes one record.  Of rows with equal payloads of at least ``revisit_from`` bytes, the one
with the smallest id is a ``response``; the others are ``revisit`` records that hold only the HTTP header and
refer to it.  Groups of equal payloads are found by their SHA-256 with salted aggregation, so that a page that
makes up a third of all rows is never gathered.  Records are text in UTF-8, so Spark's text writer (any file
system, committed per task, safe to retry) writes the archive; its line separator is the blank line pair that
ends a WARC record.

Reading: ``spark.read.format("warc").load(folder)``.  One partition per file (a record boundary cannot be told from
payload bytes without reading from the file's start; the writer splits files at ``most_records``).  The source opens
files through pyarrow.  In a store that only Spark reaches, ``read_warc`` has Spark read whole files and parses these.  Filters on
``record_type``, ``record_id``, ``target_uri``, ``payload_digest`` and ``refers_to`` are pushed down: headers
are parsed first, and the block of a record that fails them is skipped without being read or decoded.  Blocks
are also skipped when no ``payload`` column is asked for (``read_warc(..., columns)``: Spark tells a Python source
nothing of the columns that a query uses).  Files ending in ``.gz`` (one member per
record or per file) are read as streams.

Defined results: null payloads count as empty; a null id is written as ``urn:row:null``; rows that repeat the
smallest id of a group are all responses; line breaks in URLs are percent-encoded; a null URL becomes ``urn:none``;
of rows that tie in size and payload the one with the smallest id answers for all; very long payloads are one record;
other columns are ignored; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ._shared import attach, prepare, written

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Records in a file, so that one reader's part stays bounded.
MOST_RECORDS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = StructType([
    StructField("record_id", StringType()),
    StructField("record_type", StringType()),
    StructField("target_uri", StringType()),
    StructField("refers_to", StringType()),
    StructField("payload_digest", StringType()),
    StructField("payload_bytes", LongType()),
    StructField("payload", BinaryType()),
])


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column: 32 groups of five bits from 40 hex digits."""
    pairs = [(5 * i // 4, 5 * i % 4) for i in range(32)]  # first hex digit, bits of it that go before
    digits = F.sha1(data)
    letters = []
    for at, skip in pairs:
        two = F.conv(F.substring(F.concat(digits, F.lit("0")), at + 1, 2), 16, 10).cast("int")
        five = F.shiftright(two, 3 - skip).bitwiseAND(31)
        letters.append(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), five + 1, F.lit(1)))
    return F.concat(*letters)


def _name(id_col: Column) -> Column:
    return F.concat(F.lit("urn:row:"), F.coalesce(id_col.cast("string"), F.lit("null")))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, most_records: int = MOST_RECORDS) -> None:
    """Writes one record per row of ``pages`` into text files at ``path``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("body"))
    rows = rows.withColumn("size", F.octet_length("body").cast("long"))
    marks = rows.select("id", "size", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("same"))
    # which record of equal payloads is the response; payloads stay out of this shuffle
    firsts = attach(marks.where(F.col("size") >= revisit_from), ["same", "size"], F.col("id"), {"first": F.min("id")}, {"first": F.min("first")})
    later = firsts.where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("rid"), F.col("same").alias("rsame"), "first").distinct()
    later, _ = written(later, "revisits")  # its size is then known: a small one is sent to the payloads, not they to it
    rows = rows.withColumn("same", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    rows = rows.join(later, F.col("id").eqNullSafe(F.col("rid")) & (F.col("same") == F.col("rsame")), "left")
    revisit = F.col("rsame").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    url = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("urn:none"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), _name(F.col("id")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(F.col("body")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <"), _name(F.col("first")), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most_records).text(path)


class WarcFile(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: path."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)


class WarcReader(DataSourceReader):
    PUSHED = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")

    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.PUSHED:
                self.present.add(f.attribute[0])
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in self.PUSHED:
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = _store(self.path)
        info = store.get_file_info(folder)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder, recursive=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        return [WarcFile(scheme + x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.base_name[0] not in "._"]

    def read(self, partition: WarcFile) -> Iterator[tuple]:
        store, name = _store(partition.uri)
        with store.open_input_file(name) as raw:
            stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(_Seekable(raw), 1 << 20)
            for record in read_records(stream, self.wanted, "payload" in self.names, self.present):
                yield tuple(record[n] for n in self.names)


def _store(uri: str):
    from pyarrow import fs

    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


class _Seekable(io.RawIOBase):
    """A pyarrow file for ``io.BufferedReader``."""

    def __init__(self, raw):
        self.raw_file = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.raw_file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, to: int, whence: int = 0) -> int:
        self.raw_file.seek(to, whence)
        return self.raw_file.tell()

    def tell(self) -> int:
        return self.raw_file.tell()


def _headers(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()).strip(b"\r\n"):
        key, _, value = line.decode("utf-8", "replace").partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def read_records(stream, wanted: dict[str, set], with_payload: bool, present: set[str] = frozenset()) -> Iterator[dict]:
    """The records of a WARC stream whose headers hold one of ``wanted``'s values for each of its columns, and all of ``present``."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = _headers(stream)
        left = int(head["content-length"])
        record = {
            "record_id": head.get("warc-record-id", "").strip("<>") or None,
            "record_type": head.get("warc-type"),
            "target_uri": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "payload_bytes": None,
            "payload": None,
        }
        if all(record[k] in v for k, v in wanted.items()) and all(record[k] is not None for k in present):
            body = 0
            if head.get("content-type", "").startswith("application/http"):
                status = stream.readline()
                before = len(status)
                http: dict[str, str] = {}
                while (line := stream.readline()).strip(b"\r\n"):
                    before += len(line)
                    key, _, value = line.decode("latin-1").partition(":")
                    http[key.strip().lower()] = value.strip()
                left -= before + len(line)
                body = int(http.get("content-length", left))
            else:
                body = left
            record["payload_bytes"] = body
            if with_payload and record["record_type"] != "revisit":
                record["payload"] = stream.read(left)
                left = 0
            yield record
        _skip(stream, left)


def _skip(stream, n: int) -> None:
    if n and isinstance(stream, io.BufferedReader):
        stream.seek(n, 1)
    else:
        while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
            n -= got


def verify(record: dict) -> bool:
    """Whether a response's payload has the digest and the length that its headers state."""
    data = record["payload"] or b""
    return base64.b32encode(hashlib.sha1(data).digest()).decode() == record["payload_digest"] and len(data) == record["payload_bytes"]


def read_warc(spark: SparkSession, path: str, columns: Sequence[str] = tuple(SCHEMA.names)) -> DataFrame:
    """The records of an archive; without ``payload`` among the columns, payloads are not read.

    Spark pushes filters down to Python sources only if ``spark.sql.python.filterPushdown.enabled`` is set, when a plan
    is made: it is set here for the session.
    """
    prepare(spark)
    schema = StructType([SCHEMA[c] for c in columns])
    if not _opens(path):
        return _parsed(spark, path, schema)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).load(path)


def _opens(path: str) -> bool:
    """Whether pyarrow knows the store of a path."""
    try:
        store, folder = _store(path)
        store.get_file_info(folder)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _parsed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of files that Spark itself reads, one file at a time in memory."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = io.BytesIO(content.as_buffer())
                found, size = [], 0
                for record in read_records(gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw), {}, "payload" in schema.names):
                    found.append({c: record[c] for c in schema.names})
                    size += len(record["payload"] or b"")
                    if len(found) == 1000 or size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(found, kinds)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(parse, schema)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def checked_records(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, refers_to, payload_digest, payload_bytes`` of an archive, payloads held against their headers.

    Responses are read with their payloads, of which digest and length are computed again: a difference is an error.
    Revisits have none; theirs are not asked for, and responses are passed over when revisits are read.
    """
    names = ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    full = read_warc(spark, path).where("record_type = 'response'")
    found = base32_sha1(F.col("payload"))
    right = (found == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    wrong = F.raise_error(F.concat(F.lit("payload of "), F.col("record_id"), F.lit(" differs from its header"))).cast("string")
    full = full.withColumn("payload_digest", F.when(F.coalesce(right, F.lit(False)), found).otherwise(wrong))
    return full.select(*names).unionByName(read_warc(spark, path, names).where("record_type = 'revisit'").select(*names))
