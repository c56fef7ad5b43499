"""WARC archives as a data source of Spark: records are written to and read from files in a shared folder."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

#: Payloads of fewer bytes are always stored, never referred to.
LEAST_REVISIT = 100
#: A writer starts another file after so many bytes.
FILE_BYTES = 256 << 20
#: Bytes of payloads that a reader hands over in one batch.
BATCH = 8 << 20
#: Parts that the copies of one payload are dealt into.
SALTS = 16

#: Column of the source, and the header field that it comes from.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "refers_to_target_uri": "WARC-Refers-To-Target-URI", "profile": "WARC-Profile", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, headers map<string,string>, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    """Each attempt writes files of its own name; commit moves those of the attempts that count to their final names."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.most = options["path"], int(options.get("filebytes", FILE_BYTES))
        self.packed = options.get("compression", "gzip").lower() == "gzip"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        stem, files, out = uuid.uuid4().hex, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or out.tell() > self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{stem}-{len(files)}.warc{'.gz' * self.packed}")
                    out = fs.open_output_stream(f"{root}/_temporary/{files[-1]}", compression=None)
                out.write(member(record(row)) if self.packed else record(row))
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _at(self.path)
        fs.create_dir(root, recursive=True)
        for k, name in enumerate(f for m in messages if m is not None for f in m.files):
            fs.move(f"{root}/_temporary/{name}", f"{root}/part-{k:05d}-{name}")
        if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")

    def abort(self, messages: list) -> None:
        fs, root = _at(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{root}/_temporary/{name}")


def _line(value: str) -> str:
    """A header value may not hold line ends."""
    return re.sub(r"[\r\n]+", " ", value)


def record(row: dict) -> bytes:
    """A record: its header fields, those of the map headers, an HTTP header and, but for a revisit, the payload."""
    payload = row.get("payload") or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if row["record_type"] == "revisit" else payload)
    named = [(field, row[c]) for c, field in FIELDS.items() if row.get(c) is not None]
    named += [*dict(row.get("headers") or {}).items(), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in named) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member of its own, as archives have for each record, with its length in the header's extra field (subfield LN), so
    that a reader can pass over it."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    extra = 4 + 8
    whole = 10 + 2 + extra + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", extra) + b"LN" + struct.pack("<HQ", 8, whole)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _member_length(start: bytes) -> int | None:
    """What the extra field tells of the member's length, if it does."""
    if len(start) > 12 and start[3] & 4:
        size = struct.unpack_from("<H", start, 10)[0]
        at = 12
        while at + 4 <= min(12 + size, len(start)):
            name, n = start[at : at + 2], struct.unpack_from("<H", start, at + 2)[0]
            if name == b"LN" and n == 8 and at + 12 <= len(start):
                return struct.unpack_from("<Q", start, at + 4)[0]
            at += 4 + n
    return None


@dataclass
class _File(InputPartition):
    path: str
    start: int = 0


class _Reader(DataSourceReader):
    """Conditions on header columns are checked once a record's header is read; only then is its block read or skipped."""

    def __init__(self, options: dict):
        self.path, self.payloads, self.tests = options["path"], options.get("payload", "true").lower() != "false", []

    def pushFilters(self, filters: list):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append((column, type(f).__name__, f.value if not isinstance(f, IsNotNull) else None))
            else:
                yield f

    def _wanted(self, head: dict) -> bool:
        for column, kind, value in self.tests:
            found = head.get(FIELDS[column].lower())
            if found is None or kind == "EqualTo" and found != value or kind == "In" and found not in value or kind == "StringStartsWith" and not found.startswith(value):
                return False
        return True

    def partitions(self) -> list:
        fs, root = _at(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        # Folders of unfinished or hidden files are none of the archive's.
        found = [x for x in found if x.path == root or not any(p.startswith(("_", ".")) for p in x.path[len(root) :].strip("/").split("/"))]
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith((".warc", ".warc.gz"))] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _at(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as raw:
            for head, block in (packed_records if partition.path.endswith(".gz") else records)(raw, self._wanted, self.payloads):
                own = {c: head.get(field.lower()) for c, field in FIELDS.items()}
                known = {f.lower() for f in FIELDS.values()} | {"content-length"}
                rows.append(own | {"content_length": int(head["content-length"]), "headers": [(k, v) for k, v in head.items() if k not in known], "payload": block})
                held += len(block or b"")
                if held > BATCH or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema([*[(c, pa.string()) for c in FIELDS], ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _head(data: bytes, at: int) -> dict:
    """Fields by their names in lower case. A line that begins with a blank goes on with the one before; values of a field that is
    repeated are parted by line feeds, which no value holds. Bytes that are not UTF-8 are taken as Latin-1."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", text).split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record begins at byte {at}")
    out: dict = {}
    for k, _, v in (line.partition(":") for line in lines):
        k, v = k.strip().lower(), v.strip()
        out[k] = f"{out[k]}\n{v}" if k in out and k != "content-length" else v
    return out


def _payload(head: dict, block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block


def records(raw, wanted=lambda head: True, payloads: bool = True, size: int = 1 << 20) -> Iterator[tuple[dict, bytes | None]]:
    """(header with field names in lower case, payload) of each wanted record of an uncompressed archive that can seek. The
    payload is what follows the HTTP header of an HTTP block, and all of any other block; None if payloads is false.
    Blocks of records that are not wanted are passed over unread. A torn record at the end raises ValueError."""
    end, at, buffer, base = raw.size(), 0, b"", 0

    def upto(stop: int) -> None:
        nonlocal buffer, base
        if at < base or at > base + len(buffer):
            buffer, base = b"", at
            raw.seek(at)
        else:
            buffer, base = buffer[at - base :], at
            raw.seek(base + len(buffer))
        if (more := stop - base - len(buffer)) > 0:
            buffer += raw.read(max(more, size))

    while at < end:
        upto(at + 1)
        while (stop := buffer.find(b"\r\n\r\n")) < 0:
            if base + len(buffer) >= end:
                raise ValueError(f"a header that begins at byte {at} does not end")
            upto(base + len(buffer) + size)
        head = _head(buffer[:stop], at)
        length = int(head["content-length"])
        at += stop + 4
        if at + length > end:
            raise ValueError(f"the block that begins at byte {at} does not end")
        if wanted(head):
            block = None
            if payloads:
                upto(at + length)
                block = _payload(head, buffer[:length])
            yield head, block
        at += length + 4


class _Unpacked:
    """What the gzip members of a file hold, as one run of bytes. told: how long the member is that the bytes at hand began with, if
    its header says so."""

    def __init__(self, raw, size: int):
        self.raw, self.size, self.data, self.unpack = raw, size, bytearray(), None
        self.at, self.told, self.read = 0, None, 0

    def more(self) -> bool:
        """More bytes in data; False at the end of the file. A torn member raises ValueError."""
        if self.unpack is not None and not self.unpack.eof:
            if not (got := self.raw.read(self.size)):
                raise ValueError(f"the member at byte {self.at} does not end")
        else:
            got = self.unpack.unused_data if self.unpack is not None else b""
            start = self.read - len(got)
            if len(got) < 1 << 12:
                new = self.raw.read(1 << 12)
                self.read += len(new)
                got += new
            if not got:
                return False
            self.told = None if self.data else _member_length(got)
            self.at, self.unpack = start, zlib.decompressobj(31)
            self.data += self.unpack.decompress(got)
            return True
        self.read += len(got)
        self.data += self.unpack.decompress(got)
        return True

    def leave(self) -> None:
        """On to the next member, without reading the rest of this one."""
        self.read = self.at + self.told
        self.raw.seek(self.read)
        self.unpack, self.told = None, None
        self.data.clear()


def packed_records(raw, wanted=lambda head: True, payloads: bool = True, size: int = 1 << 16) -> Iterator[tuple[dict, bytes | None]]:
    """records() of an archive of gzip members. As a rule each record has a member of its own, but a member may hold several records, and a
    record may go on in the next member. Of a record that is not wanted the block is unpacked but not kept; where a member tells
    its length, as those of this module's writer do, it holds one record and the reader goes straight on to the next."""
    raw.seek(0)
    held = _Unpacked(raw, size)
    while True:
        # Records end in two line ends.
        blank = 0
        while blank < len(held.data) and held.data[blank] in b"\r\n":
            blank += 1
        del held.data[:blank]
        if not held.data:
            if not held.more():
                return
            continue
        while (stop := held.data.find(b"\r\n\r\n")) < 0:
            if not held.more():
                raise ValueError(f"a header that begins in the member at byte {held.at} does not end")
        head = _head(bytes(held.data[:stop]), held.at)
        del held.data[: stop + 4]
        need, want = int(head["content-length"]), wanted(head)
        if want and payloads:
            while len(held.data) < need:
                if not held.more():
                    raise ValueError(f"the block in the member at byte {held.at} does not end")
            yield head, _payload(head, bytes(held.data[:need]))
        elif want:
            yield head, None
        if held.told is not None:
            held.leave()
            continue
        while need > len(held.data):
            need -= len(held.data)
            held.data.clear()
            if not held.more():
                raise ValueError(f"the block in the member at byte {held.at} does not end")
        del held.data[:need]


class WarcSource(DataSource):
    """Format warc. Reading: path (a .warc or .warc.gz file, or a folder that holds such at any depth), payload=false to leave blocks unread. Writing: columns of
    FIELDS, headers and payload, any of them but record_type and record_id missing; mode append into a new folder;
    compression gzip (a member for each record) or none."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record for each row, payload the text in UTF-8 (null: empty).

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest id (one, unless its row is
    repeated) are responses and the others revisit it; smaller payloads and rows without an id are responses. Only
    digests and ids are shuffled to find them; repeated payloads then meet their first in SALTS parts."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "_salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")})
    again = (
        rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("id", "digest")
        .groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    met = rows.join(again, ["digest", "_salt"], "left")
    old = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    out = met.select(
        F.when(old, "revisit").otherwise("response").alias("record_type"), F.coalesce(urn(F.col("id")), F.lit("<urn:page:>")).alias("record_id"), "target_uri", F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(old, urn(F.col("first"))).alias("refers_to"), F.when(old, PROFILE).alias("profile"), F.lit("application/http; msgtype=response").alias("content_type"),
        F.create_map(F.lit("X-Payload-Length"), F.octet_length("payload").cast("string")).alias("headers"), F.when(~old, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (an id) for each record of write_pages, responses
    measured on the payloads read back, revisits told by their headers; their blocks are not read."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1)
    ids = lambda c: F.when(number(c) != "", number(c).cast("long"))
    responses = spark.read.format("warc").load(path).where("record_type = 'response'")
    revisits = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    return responses.select(ids(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).union(
        revisits.select(ids(F.col("record_id")), F.col("headers")["x-payload-length"].cast("long"), F.substring_index("payload_digest", ":", -1), "record_type", ids(F.col("refers_to")))
    )
