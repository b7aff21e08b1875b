"""WARC archives as a PySpark data source.

Reading plans one partition for each stretch of about ``split_bytes`` of a file that this
source wrote, aligned to records by the starts that its manifest lists. Other archives, found
by their names (``.warc``, ``.warc.gz``) where no manifest lists them, are read too, one
partition each, as their records' places aren't known. Filters on record_type, target_uri,
record_id, page_id and payload_digest are pushed into the scan: headers are parsed first, and
a record that they rule out, or whose payload isn't asked for (``payload=false``), is passed
over: by its compressed length where the source wrote it, by seeking in a plain file, else by
inflating without keeping. What is read of a payload is checked: the length against
Content-Length, members against their CRC-32, a response's payload against its digest.
``payload=check`` does so without returning payloads. A damaged record is an error.

Writing makes one file for each task attempt under a name of its own; the driver's commit
leaves a manifest of the files of the attempts that won, one for each write, so that writes
in append mode add up. An attempt that is lost or repeated leaves a file that nobody reads.
Record ids are made of page ids; they are unique if these are. A record of 4 GiB or more is
refused.

Paths may be local, file: URIs, or any URI that ``pyarrow.fs`` resolves.

``revisits`` decides which records repeat an equal payload; ``archive`` and ``pages`` write
and read back a table of pages.

Defined results: a null payload is empty; null ids and addresses are written as empty
headers and read as null; repeated rows are records of their own; other columns are ignored;
an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..sources.packaging import ship
from ..sources.shared import shared_path

SCHEMA = "record_id string, record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
WRITE_SCHEMA = "page_id long, url string, payload binary, record_type string, refers_to long, payload_bytes long, payload_digest string"
PUSHED = ("record_type", "target_uri", "record_id", "page_id", "payload_digest")
SPLIT_BYTES = 16_000_000
#: Leads the names of manifests; the archives that are listed in none are read without one.
MANIFEST = "_MANIFEST-"
INDEX_EVERY = 1_000_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


#: A gzip member's extra field holds its own compressed length, so that a reader can pass over it.
_EXTRA = b"WL"


def member(head: bytes, body: bytes) -> bytes:
    """A gzip member of a record. Headers are flushed first, so that they inflate without the body; the extra field holds the length of the whole."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = pack.compress(head) + pack.flush(zlib.Z_SYNC_FLUSH) + pack.compress(body) + pack.flush()
    crc = zlib.crc32(body, zlib.crc32(head))
    lead = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
    size = len(lead) + 2 + 8 + len(data) + 8
    if max(size, len(head) + len(body)) >= 1 << 32:
        raise ValueError(f"a record of {len(body)} bytes is too large for a gzip member")
    return lead + struct.pack("<H", 8) + _EXTRA + struct.pack("<HI", 4, size) + data + struct.pack("<II", crc, (len(head) + len(body)) & 0xFFFFFFFF)


def encode_record(row: dict, date: str) -> bytes:
    payload = bytes(row["payload"] or b"")
    kind = row["record_type"]
    stored = b"" if kind == "revisit" else payload
    clean = lambda x: (x or "").replace("\r", "%0D").replace("\n", "%0A")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(row["page_id"]),
        "WARC-Date": date,
        "WARC-Target-URI": clean(row["url"]),
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}",
        "X-Payload-Length": str(row["payload_bytes"]),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(stored)),
    }
    if kind == "revisit":
        head |= {"WARC-Refers-To": record_id(row["refers_to"]), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return member(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n", stored + b"\r\n\r\n")


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _fields(head: dict[str, str]) -> dict:
    kind = head.get("warc-type")
    length = head.get("x-payload-length") or head.get("content-length") or "0"
    return {
        "record_id": head.get("warc-record-id"),
        "record_type": kind,
        "page_id": page_of(head.get("warc-record-id")),
        "target_uri": head.get("warc-target-uri") or None,
        "payload_bytes": int(length),
        "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "refers_to": page_of(head.get("warc-refers-to")),
    }


@dataclass
class Stretch(InputPartition):
    """begin to end of a file that this source wrote; end 0: a whole file of any origin."""

    path: str
    begin: int = 0
    end: int = 0


@dataclass
class Wrote(WriterCommitMessage):
    name: str = ""
    size: int = 0
    starts: list[int] = field(default_factory=list)


def _list(path: str) -> tuple[list[dict], list[str]]:
    """Files that manifests under a path list, and the names of other archives there."""
    from pyarrow import fs as pafs

    fs, root = _filesystem(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [], [""]
    found = fs.get_file_info(pafs.FileSelector(root))
    listed = []
    for x in found:
        if x.base_name.startswith(MANIFEST):
            with fs.open_input_stream(x.path) as f:
                listed.append(json.loads(f.read()))
    ours = {name for m in listed for name in m["attempts"]}
    others = [x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz")) and x.base_name not in ours and not x.base_name.startswith("part-docscreen-")]
    return [x for m in listed for x in m["files"]], sorted(others)


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names, self.path = schema.names, options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower()
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                old = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = values if old is None else old & values
            else:
                yield f

    def partitions(self):
        files, others = _list(self.path)
        out = [Stretch(f"{self.path}/{name}" if name else self.path) for name in others]
        for x in files:
            begin = 0
            for at in [*x["starts"], x["size"]]:
                if at > begin and (at - begin >= self.split or at == x["size"]):
                    out.append(Stretch(f"{self.path}/{x['name']}", begin, at))
                    begin = at
        return out or [Stretch("")]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        if part.path:
            fs, path = _filesystem(part.path)
            with fs.open_input_file(path) as f:
                each = read_records(f, part.begin, part.end, self.wanted, self.payload) if part.end else read_any(f, self.wanted, self.payload)
                for row in each:
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) == 5000 or held > 8_000_000:
                        yield _batch(rows, self.names)
                        rows, held = [], 0
        yield _batch(rows, self.names)


_KINDS = {"record_id": pa.string(), "record_type": pa.string(), "page_id": pa.int64(), "target_uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[n]) for n in names], names)


def _unwanted(row: dict, wanted: dict[str, set]) -> bool:
    return any(row[k] not in values for k, values in wanted.items())


def _payload(row: dict, head: dict[str, str], body: bytes, mode: str) -> bytes | None:
    """The payload of a record's block, checked; None if it isn't asked for."""
    if len(body) != int(head.get("content-length") or 0):
        raise ValueError(f"{row['record_id']}: {len(body)} bytes, not the {head.get('content-length')} of Content-Length")
    if head.get("content-type", "").startswith("application/http"):
        lead, _, content = body.partition(b"\r\n\r\n")
        plain = not re.search(rb"(?im)^(transfer|content)-encoding:", lead)
    else:
        content, plain = body, True
    named = head.get("warc-payload-digest", "")
    if row["record_type"] == "response" and plain and named.startswith("sha1:") and digest(content) != named.removeprefix("sha1:"):
        raise ValueError(f"{row['record_id']}: the payload isn't that of its digest")
    return content if mode == "true" else None


def read_records(f, begin: int, end: int, wanted: dict[str, set], payload: str = "true", block: int = 1 << 20) -> Iterator[dict]:
    """Records of a stretch of a file that this source wrote: headers first, bodies only of those that are wanted."""
    f.seek(begin)
    have, at = b"", begin  # have: bytes from at on
    while at < end:
        if len(have) < 20:
            have += f.read(block)
        if have[:3] != b"\x1f\x8b\x08" or not have[3] & 4 or have[12:14] != _EXTRA:
            raise ValueError(f"not a record's gzip member at byte {at}")
        size = struct.unpack("<I", have[16:20])[0]
        while len(have) < size:
            more = f.read(max(block, size - len(have)))
            if not more:
                raise ValueError(f"the file ends within the record at byte {at}")
            have += more
        data, crc, have, at = have[20 : size - 8], struct.unpack("<I", have[size - 8 : size - 4])[0], have[size:], at + size
        inflate = zlib.decompressobj(-15)
        raw = inflate.decompress(data, 1024)
        while (cut := raw.find(b"\r\n\r\n")) < 0 and not inflate.eof and inflate.unconsumed_tail:
            raw += inflate.decompress(inflate.unconsumed_tail, 4096)
        head = parse_headers(raw[:cut])
        row = _fields(head)
        if _unwanted(row, wanted):
            continue
        row["payload"] = None
        if payload != "false" and row["record_type"] != "revisit":
            raw += inflate.decompress(inflate.unconsumed_tail) + inflate.flush()
            if zlib.crc32(raw) != crc:
                raise ValueError(f"{row['record_id']}: damaged, its CRC-32 differs")
            row["payload"] = _payload(row, head, raw[cut + 4 : -4], payload)
        yield row


class Inflated:
    """The bytes of a file of gzip members, or of a plain one, to be read on and on. Members' CRC-32s are checked by zlib."""

    def __init__(self, f, block: int = 1 << 18):
        self.f, self.block, self.have, self.at = f, block, b"", 0
        self.gzip = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        self.inflate, self.rest = zlib.decompressobj(31), b""

    def more(self) -> bool:
        if not self.gzip:
            new = self.f.read(self.block)
        else:
            new = b""
            while not new:
                data = self.rest or self.f.read(self.block)
                if not data:
                    if self.inflate is not None and not self.inflate.eof and self.at:
                        raise ValueError("the file ends within a gzip member")
                    return False
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                new = self.inflate.decompress(data, self.block)
                self.rest = self.inflate.unconsumed_tail or self.inflate.unused_data
                self.at = 1
        self.have += new
        return bool(new)

    def until(self, mark: bytes) -> bytes | None:
        """What comes before a mark, which is passed over; None at the end of the file."""
        looked = 0
        while (i := self.have.find(mark, looked)) < 0:
            looked = max(0, len(self.have) - len(mark))
            if not self.more():
                return None
        out, self.have = self.have[:i], self.have[i + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes; passed over unless they are to be kept."""
        if not keep and not self.gzip and n > len(self.have):
            self.f.seek(n - len(self.have), 1)
            self.have = b""
            return b""
        parts = []
        while n:
            if not self.have and not self.more():
                raise ValueError("the file ends within a record")
            part, self.have = self.have[:n], self.have[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


def read_any(f, wanted: dict[str, set], payload: str = "true") -> Iterator[dict]:
    """Records of an archive of any origin, from its begin to its end."""
    source = Inflated(f)
    while True:
        if not source.have and not source.more():
            return
        raw = source.until(b"\r\n\r\n")
        if raw is None:
            raise ValueError("the file ends within a record's headers")
        head = parse_headers(raw)
        row = _fields(head)
        keep = payload != "false" and row["record_type"] != "revisit" and not _unwanted(row, wanted)
        body = source.take(int(head.get("content-length") or 0), keep)
        if source.take(4, True) != b"\r\n\r\n":
            raise ValueError(f"{row['record_id']}: its block doesn't end where Content-Length says")
        if not _unwanted(row, wanted):
            row["payload"] = _payload(row, head, body, payload) if keep else None
            yield row


class WarcWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names, self.path, self.overwrite = schema.names, options["path"], overwrite
        self.date = options.get("date") or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, rows) -> Wrote:
        out = Wrote(f"part-docscreen-{uuid.uuid4().hex}.warc.gz")
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{out.name}", compression=None) as f:
            last = 0
            for row in rows:
                raw = encode_record(row.asDict(), self.date)
                if out.size - last >= INDEX_EVERY:
                    out.starts.append(out.size)
                    last = out.size
                f.write(raw)
                out.size += len(raw)
        return out

    def commit(self, messages) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        old = _list(self.path)[0] if self.overwrite else []
        manifests = [x.path for x in fs.get_file_info(_selector(root)) if x.base_name.startswith(MANIFEST)] if self.overwrite else []
        files = [{"name": m.name, "size": m.size, "starts": m.starts} for m in messages if m and m.size]
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}", compression=None) as f:
            f.write(json.dumps({"files": files, "attempts": [m.name for m in messages if m]}).encode())
        for path in [*manifests, *(f"{root}/{x['name']}" for x in old)]:
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, root = _filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.name}")


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options path, payload, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """WRITE_SCHEMA rows: of equal payloads of at least least_bytes the one with the greatest page_id is a response that the others revisit.

    Digests are aggregated before they are shuffled. The rows go to the join with their
    payloads' digests alone in the key; Spark splits a digest that many rows share.
    """
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    last = rows.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    repeat = (F.col("payload_bytes") >= least_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    joined = rows.join(last, "sha1", "left")
    return joined.select(
        "page_id",
        "url",
        F.when(repeat, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        F.when(repeat, "revisit").otherwise("response").alias("record_type"),
        F.when(repeat, F.col("last")).alias("refers_to"),
        "payload_bytes",
        base32(F.col("sha1")).alias("payload_digest"),
    )


def base32(hex_digest):
    """Upper-case base32 of a hexadecimal SHA-1: eight groups of five digits make four letters each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(alphabet, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def archive(pages: DataFrame, path: str, mode: str = "append", **columns) -> None:
    """Write a record for each row of pages to WARC files under path."""
    register(pages.sparkSession)
    revisits(pages, **columns).write.format("warc").mode(mode).option("path", path).save()


def read(spark: SparkSession, path: str, payload: str = "true") -> DataFrame:
    """payload: "true", "false", or "check" to check stored payloads without returning them."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write pages as WARC files in the shared folder and read them back; stored payloads are checked against their digests."""
    path = shared_path(pages.sparkSession, "warc")
    archive(pages, path, **columns)
    return read(pages.sparkSession, path, payload="check")
