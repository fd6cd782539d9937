"""WARC records in ZIP-packaged archives: write them, and read them back by ranges."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Bytes of records that an archive is closed after.
ARCHIVE_BYTES = 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: When records are said to be taken; pages carry no date of their own.
DATE = "2000-01-01T00:00:00Z"
# Fixed value: the profile of a revisit whose payload has the digest of an earlier record.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: str | None) -> list[str]:
    return [] if value is None else [f"{name}: " + value.replace("\r", "%0D").replace("\n", "%0A")]


def record(name: str, page_id: str | None, url: str | None, payload: bytes, kind: str, refers_to: str | None = None, refers_url: str | None = None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member; `name` makes its id, which no other record has.

    A revisit has no block and names the page that it repeats. The tables' ids
    go in headers of their own (Page-ID, Refers-To-Page-ID): they may be null or
    repeated, which a record's id may not.
    """
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", *_line("WARC-Target-URI", url), *_line("Page-ID", page_id)]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", *_line("WARC-Refers-To-Target-URI", refers_url), f"WARC-Refers-To-Date: {date}", *_line("Refers-To-Page-ID", refers_to)]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def surt(url: str | None) -> str:
    """A URL's key in an index: host labels from the last to the first, then the path; `-` without one."""
    host, slash, path = (url or "").partition("://")[2].partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower()
    return re.sub(r"\s", "%20", f"{','.join(reversed(host.split('.')))}){slash}{path}") if host else "-"


def parse(member: bytes) -> dict:
    """Headers of a gzip-packed record, with its block under `block`."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields | {"block": rest[: int(fields["Content-Length"])]}


def pack_zip(members: Iterable[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file of stored members. Its comment is the line feed that a text writer ends a row with.

    The row itself lacks that last byte; the file on disk has it.
    """
    out, directory, n = io.BytesIO(), [], 0
    for name, data in members:
        at, raw, crc = out.tell(), name.encode(), zlib.crc32(data)
        out.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(raw), 0) + raw + data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if zip64 else b""
        size = 0xFFFFFFFF if zip64 else len(data)
        directory.append(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if zip64 else at) + raw + extra)
        n += 1
    at, body = out.tell(), b"".join(directory)
    out.write(body)
    if zip64:
        end = out.tell()
        out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(body), at))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
    out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF if zip64 else n, 0xFFFF if zip64 else n, 0xFFFFFFFF if zip64 else len(body), 0xFFFFFFFF if zip64 else at, 1))
    return out.getvalue()


class ZipRanges:
    """The stored members of a ZIP file, read by ranges from a seekable file: no member is extracted."""

    def __init__(self, file: BinaryIO):
        self.file = file
        size = file.seek(0, 2)
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        locator = self.read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
        if locator[:4] == b"PK\6\7" and (n == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF):
            end64 = self.read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end64[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            n, length, at = struct.unpack("<QQQ", end64[32:56])
        self.members = dict(self._directory(self.read(at, length), n))

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("the archive is shorter than its directory says")
        return data

    def _directory(self, raw: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        i = 0
        for _ in range(n):
            if raw[i : i + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, packed, size, name_n, extra_n, note_n, at = (*struct.unpack("<H", raw[i + 10 : i + 12]), *struct.unpack("<IIHHH", raw[i + 20 : i + 34]), *struct.unpack("<I", raw[i + 42 : i + 46]))
            name, extra = raw[i + 46 : i + 46 + name_n].decode("utf-8"), raw[i + 46 + name_n : i + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, k = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: only the fields that are all ones above, in this order
                    wide = [v[0] for v in struct.iter_unpack("<Q", extra[4 : 4 + k // 8 * 8])]
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    at = wide.pop(0) if at == 0xFFFFFFFF else at
                extra = extra[4 + k :]
            yield name, (method, at, size)
            i += 46 + name_n + extra_n + note_n

    def member(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        method, at, size = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.read(at, 30)
        return at + 30 + sum(struct.unpack("<HH", head[26:30])), size

    def index(self) -> list[dict]:
        """Entries of all index members: where each record lies in its archive member."""
        names = [n for n in self.members if n.startswith("indexes/")]
        return [json.loads(line.split(b" ", 2)[2]) for n in names for line in self.read(*self.member(n)).splitlines()]

    def records(self) -> Iterator[dict]:
        """Every record that the indexes list, each by its own range."""
        begins = {n: self.member(n)[0] for n in self.members if n.startswith("archive/")}
        for e in self.index():
            yield parse(self.read(begins[e["filename"]] + e["offset"], e["length"]))


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, spread_n: int = 32) -> DataFrame:
    """(page_id, url, html, record_type, refers_to, refers_url): the first page of equal payloads is the response.

    First means smallest id; null ids come last and repeated rows of the first
    page are responses each. Payloads under `least` bytes are all responses. The
    minimum per digest is taken before the shuffle, and only digests met more
    than once are joined back, in spread_n parts, so a hot payload is split.
    """
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("_sha", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    rows = rows.withColumn("_sha", F.when(F.octet_length("html") >= least, F.col("_sha")))
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = rows.where(F.col("_sha").isNotNull()).groupBy("_sha").agg(F.min(known).alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    first = first.select("_sha", "_first", F.explode(F.sequence(F.lit(0), F.lit(spread_n - 1))).alias("_part"))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(spread_n)).cast("int")
    joined = rows.withColumn("_part", part).join(first, ["_sha", "_part"], "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    return joined.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first.page_id")).alias("refers_to"), F.when(again, F.col("_first.url")).alias("refers_url"))


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write records (see typed()) as ZIP files in the folder path, on any file system that Spark writes to.

    Each archive is one row, so a task holds archive_bytes and one more record.
    The text writer puts the bytes down as they are, one file a row.
    """
    folder = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def archive() -> pd.DataFrame:
            nonlocal n, data, entries, size
            entries.sort()
            out = pack_zip([(DATA, b"".join(data)), (INDEX, "".join(entries).encode())])
            n, data, entries, size = n + 1, [], [], 0
            return pd.DataFrame({"content": [out]})

        data, entries, size = [], [], 0
        given = lambda x: None if pd.isna(x) else x
        for pdf in batches:
            for page, url, html, kind, refers, refers_url in zip(*(pdf[c] for c in ("page_id", "url", "html", "record_type", "refers_to", "refers_url")), strict=True):
                raw = record(f"{folder}/{task}/{n}/{len(data)}", given(page), given(url), html.encode("utf-8", "surrogatepass"), kind, given(refers), given(refers_url))
                entries.append(f"{surt(given(url))} {re.sub('[^0-9]', '', DATE)} {json.dumps({'offset': size, 'length': len(raw), 'filename': DATA})}\n")
                data.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield archive()
        if data:
            yield archive()

    # ids travel as text: pandas would make floats of long ids beside null ones
    rows = records.select(F.col("page_id").cast("string"), "url", "html", "record_type", F.col("refers_to").cast("string"), "refers_url")
    zipped = rows.mapInPandas(run, "content binary")
    zipped.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def opener(path: str) -> tuple[str, str] | None:
    """What pyarrow's file systems read a folder by, (uri, its name there); None if they can't open it."""
    from pyarrow import fs

    uri = path if "://" in path else path.replace("file:", "file://", 1)
    try:
        system, name = fs.FileSystem.from_uri(uri)
        return (uri, name) if system.get_file_info(name).type != fs.FileType.NotFound else None
    except (OSError, ValueError):
        return None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives under path.

    Spark lists the files; tasks open them by pyarrow's file systems and read the
    directory, the index and each record by their ranges. In a store that only
    Spark's readers open, a file's bytes come from those, and ranges are taken
    of them: such an archive must fit in a task, as its writer sees to.
    """
    ranged = opener(path) is not None

    def rows_of(file: BinaryIO) -> pd.DataFrame:
        rows = []
        for r in ZipRanges(file).records():
            kind, length = r["WARC-Type"], int(r["WARC-Payload-Length"])
            stated = r["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (len(r["block"]) != length or digest(r["block"]) != stated):
                raise ValueError(f"record {r['WARC-Record-ID']} doesn't have the payload it states")
            rows.append((r.get("Page-ID"), length, stated, kind, r.get("Refers-To-Page-ID")))
        return pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            if ranged:
                for at in pdf["path"]:
                    system, name = fs.FileSystem.from_uri(at if "://" in at else at.replace("file:", "file://", 1))
                    with system.open_input_file(name) as file:
                        yield rows_of(file)
            else:
                for content in pdf["content"]:
                    yield rows_of(io.BytesIO(content))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path" if ranged else "content")
    found = files.mapInPandas(run, RECORDS.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write a record per page to archives in the shared folder and read them back.

    A null payload is empty; null URLs have no target line; ties and repeated
    rows are as in typed(); an empty table gives no archives and no rows; other
    columns are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(typed(pages, id_col, url_col, payload_col, least), path)
    return read_archives(spark, path)
