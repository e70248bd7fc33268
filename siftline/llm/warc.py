"""WARC archives as a PySpark Python data source (format ``siftline_warc``).

Writing: one gzip member per record, written by tasks under attempt names that the driver renames on commit.  Each
member carries its compressed length in a gzip extra field (``SL``), so a reader can step over a record.
Reading: one partition per file; predicates on the record type and on header fields are pushed to the reader,
which inflates a record's headers first, drops it if they do not match, and never inflates a payload nobody wants
(option ``payload``: ``full``; ``check`` verifies digest and length without returning it; ``none`` skips it).
Archives of other writers work too: plain records are stepped over by Content-Length, members without the extra
field are inflated to their end.

Spark keeps what was pushed with the loaded table, so a table that two plans filter differently would lose rows.
``read_archives`` therefore loads anew for each set of conditions, pushes exactly those, and seals the frame: later
predicates are applied to its rows and do not reach the reader.  Pushing needs the session setting
``spark.sql.python.filterPushdown.enabled``, which ``register`` switches on and leaves on, as plans are made lazily.

Defined results: a null html is an empty payload; a null url has no target header and reads back null; a null
page_id is smaller than any other and reads back null; of repeated rows with one payload exactly one is a response;
an empty table gives an empty result; further columns are ignored.
"""
import base64
import hashlib
import re
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from ..session import new_run_folder
from .common import file_system, row_identity, stored, text_bytes

FORMAT = "siftline_warc"
SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, page_id long, "
    "payload_bytes long, refers_to long, payload binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
WRITE_SCHEMA = "page_id long, url string, record_type string, refers_to long, row_id long, payload string"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_LEVEL = 6
HEAD = 4096


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, row_id):
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{row_id}'.encode()).digest()[:16])}>"


def _header_text(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id, url, record_type, refers_to, row_id, payload: bytes) -> bytes:
    """One record: header fields, blank line, block, two line ends."""
    fields = [("WARC-Type", record_type), ("WARC-Record-ID", _record_id(page_id, row_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_text(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields.append(("X-Payload-Length", str(len(payload))))
    block = b""
    if record_type == "revisit":
        fields.append(("WARC-Profile", REVISIT_PROFILE))
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    else:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        block = http.encode() + payload
        fields.append(("Content-Type", "application/http;msgtype=response"))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``SL`` holds its whole length; 0 where 32 bits do not hold it."""
    deflate = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"SL", 8, total)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(head: bytes) -> dict:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k}


def _values(fields: dict) -> dict:
    number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    digest = fields.get("warc-payload-digest")
    return {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "payload_digest": digest.partition(":")[2] if digest else None, "page_id": number("x-page-id"),
        "payload_bytes": number("x-payload-length"), "refers_to": number("x-refers-to-page-id"),
    }


_TESTS = {
    EqualTo: lambda a, b: a is not None and a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a is not None and a in b,
    GreaterThan: lambda a, b: a is not None and a > b, GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b, LessThanOrEqual: lambda a, b: a is not None and a <= b,
    StringStartsWith: lambda a, b: a is not None and a.startswith(b), StringEndsWith: lambda a, b: a is not None and a.endswith(b),
    StringContains: lambda a, b: a is not None and b in a, IsNull: lambda a, b: a is None, IsNotNull: lambda a, b: a is not None,
}


class WarcDataSource(DataSource):
    """Options: ``path`` (a folder of archives), ``payload`` (full, check or none)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "full"))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


class WarcPartition(InputPartition):
    def __init__(self, path, size):
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, folder, payload):
        self.folder, self.payload, self.tests = folder, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in COLUMNS[:-1]:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.folder)
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if re.search(r"/[^/_.][^/]*\.warc(\.gz)?$", f.path)]
        # largest first, so that the last tasks to start are short
        parts = [WarcPartition(f.path, f.size) for f in sorted(found, key=lambda f: (-f.size, f.path))]
        return parts or [WarcPartition(None, 0)]

    def wants(self, values) -> bool:
        return all(_TESTS[kind](values[name], value) for kind, name, value in self.tests)

    def read(self, partition):
        import pyarrow as pa

        types = dict(zip(COLUMNS, [pa.string()] * 4 + [pa.int64()] * 3 + [pa.binary()]))

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in COLUMNS], COLUMNS)

        if partition.path is None:
            return
        system, _ = file_system(self.folder)
        rows, held = [], 0
        with system.open_input_file(partition.path) as stream:
            for values in self.records(stream, partition.size):
                rows.append(values)
                held += len(values["payload"] or b"")
                if len(rows) == 5000 or held > 16 << 20:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    def records(self, stream, size):
        """Matching records of one archive; the stream moves past all others by their lengths."""
        place = 0
        while place < size:
            stream.seek(place)
            start = stream.read(min(HEAD, size - place))
            if start[:2] == b"\x1f\x8b":
                values, place = self._member(stream, place, start, size)
            elif start[:5] == b"WARC/":
                values, place = self._plain(stream, place, start)
            elif not start.strip(b"\r\n"):
                break
            else:
                raise ValueError(f"no WARC record at byte {place}")
            if values is not None:
                yield values

    def _member(self, stream, place, start, size):
        flags, at, total = start[3], 10, 0
        if flags & 4:
            extra = struct.unpack_from("<H", start, at)[0]
            fields, at = start[at + 2:at + 2 + extra], at + 2 + extra
            while len(fields) >= 4:
                length = struct.unpack_from("<H", fields, 2)[0]
                if fields[:2] == b"SL" and length == 8:
                    total = struct.unpack_from("<Q", fields, 4)[0]
                fields = fields[4 + length:]
        for bit in (8, 16):  # a name and a comment end with a zero byte
            if flags & bit:
                at = start.index(b"\0", at) + 1
        at += 2 if flags & 2 else 0
        inflate, data, chunk = zlib.decompressobj(-15), b"", start[at:]
        stream.seek(place + len(start))
        while b"\r\n\r\n" not in data and not inflate.eof:
            data += inflate.decompress(inflate.unconsumed_tail + chunk, HEAD)
            chunk = b"" if inflate.unconsumed_tail else stream.read(HEAD)
            if not chunk and not inflate.unconsumed_tail and not inflate.eof:
                raise ValueError(f"archive ends inside the record at byte {place}")
        head, _, block = data.partition(b"\r\n\r\n")
        fields = parse_head(head)
        values = _values(fields)
        wanted = self.wants(values)
        if total and not (wanted and self.payload != "none"):
            return ({**values, "payload": None} if wanted else None), place + total
        parts = [block]
        while not inflate.eof:
            parts.append(inflate.decompress(inflate.unconsumed_tail + chunk))
            chunk = b"" if inflate.eof else stream.read(1 << 18)
            if not chunk and not inflate.eof:
                raise ValueError(f"archive ends inside the record at byte {place}")
        left = len(inflate.unused_data)
        end = stream.tell() - left + 8 if not total else place + total
        return (self._with_payload(values, fields, b"".join(parts)) if wanted else None), end

    def _plain(self, stream, place, start):
        data = start
        while b"\r\n\r\n" not in data:
            more = stream.read(HEAD)
            if not more:
                raise ValueError(f"archive ends inside the record at byte {place}")
            data += more
        head = data.partition(b"\r\n\r\n")[0]
        fields = parse_head(head)
        values, begin, length = _values(fields), place + len(head) + 4, int(fields.get("content-length", 0))
        if not self.wants(values):
            return None, begin + length + 4
        if self.payload == "none":
            return {**values, "payload": None}, begin + length + 4
        stream.seek(begin)
        return self._with_payload(values, fields, stream.read(length)), begin + length + 4

    def _with_payload(self, values, fields, block):
        if values["record_type"] != "response":
            return {**values, "payload": None}
        block = block[:int(fields.get("content-length", len(block)))]
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        digest = sha1_base32(payload)
        if self.payload == "check" and values["payload_digest"] not in (None, digest):
            raise ValueError(f"digest of {values['record_id']} does not match its payload")
        return {**values, "payload_digest": digest, "payload_bytes": len(payload), "payload": payload if self.payload == "full" else None}


class _Written(WriterCommitMessage):
    def __init__(self, name):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder):
        self.folder = folder

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = file_system(self.folder)
        stream, name = None, None
        for batch in iterator:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for *values, payload in zip(*columns, text_bytes(batch.column(5))):
                if stream is None:
                    system.create_dir(root, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    stream = system.open_output_stream(f"{root}/_{name}", compression=None)
                stream.write(gzip_member(build_record(*values, payload)))
        if stream is not None:
            stream.close()
        return _Written(name)

    def commit(self, messages):
        system, root = file_system(self.folder)
        system.create_dir(root, recursive=True)
        for message in messages:
            if message is not None and message.name:
                system.move(f"{root}/_{message.name}", f"{root}/{message.name}")

    def abort(self, messages):
        """Attempt files keep their leading underscore, which readers pass over."""


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows of WRITE_SCHEMA: of equal payloads of at least ``min_bytes`` the largest page_id is the response."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
        row_identity(pages).alias("row_id"),
    ).withColumn("_key", F.unhex(F.sha2(F.col("payload"), 256)))
    holder = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row_id")
    keep = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("_key").agg(F.max(holder).alias("_keep"), F.count("*").alias("_n"))
    # only payloads that occur again are looked up; a stored side lets adaptive execution split a hot one
    repeated = stored(keep.filter("_n > 1").select("_key", "_keep"), "repeated-payloads")
    joined = rows.join(repeated, "_key", "left")
    revisit = F.col("_keep").isNotNull() & (F.col("row_id") != F.col("_keep.row_id"))
    return joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_keep.page_id")).alias("refers_to"), "row_id", "payload")


def register(spark: SparkSession):
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0):
    register(pages.sparkSession)
    plan_records(pages, min_bytes).write.format(FORMAT).mode("append").option("path", folder).save()


def _sealed(df: DataFrame) -> DataFrame:
    """The same rows behind a sample of all of them, through which Spark moves no predicate."""
    return df.sample(withReplacement=False, fraction=1.0, seed=0)


def read_archives(spark: SparkSession, folder: str, payload: str = "full", *conditions) -> DataFrame:
    """Records of all archives in a folder that meet the conditions, each a predicate that the reader is given."""
    register(spark)
    found = spark.read.format(FORMAT).option("path", folder).option("payload", payload).load()
    for condition in conditions:
        found = found.filter(condition)
    return _sealed(found)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back with checked payloads."""
    folder = new_run_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, min_bytes)
    found = read_archives(pages.sparkSession, folder, "check", F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
