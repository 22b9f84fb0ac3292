"""WARC in ZIP packages: a writer, and a reader that parses the central and ZIP64 directories, finds the
stored archive members and their indexes, and range-reads records without extraction.

A package holds `archive/data.warc.gz`, stored, whose records are gzip members of their own, and
`indexes/index.cdx`, a line for each record with its offset and length in that member. Packages are
written to the shared folder by the tasks that hold the rows, each under a name of its own attempt, and
only the names that tasks return are read.

Of records with equal payloads of least bytes or more, those with the smallest id are responses, others
revisit that id; shorter payloads are all responses.

Edge cases. Null or empty payload: an empty response. Very long payloads: whole, one record; a package closes
after the record that fills it. Ties and repeated rows: rows that share an id and a payload are written each,
with the same record type. A null id comes after all others and is written as such; if only null ids share a
payload, all of them are responses. An empty table gives no packages and no records. Ids may be of any type
that text can be cast to. Other columns aren't written, so their names don't matter. Packages stay in the
shared folder, as the reader may come later; `remove` deletes them."""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path

#: Payloads of fewer bytes are written anew each time.
MIN_REVISIT = 100
#: Of payload in a package, about.
PACKAGE_BYTES = 32 << 20
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

# Signatures and sizes of the ZIP format's structures (APPNOTE 4.3).
LOCAL, CENTRAL, EOCD, EOCD64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


# ---- ZIP


def local_header(name: str, crc: int, size: int) -> bytes:
    """With a ZIP64 field, so that a member of any size has a header of the same length."""
    raw = name.encode()
    extra = struct.pack("<HHQQ", 1, 16, size, size)
    return struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 0x21, crc, MAX32, MAX32, len(raw), len(extra)) + raw + extra


def directory(members: list[tuple[str, int, int, int]], at: int, zip64: bool | None = None) -> bytes:
    """Central directory and end records of (name, crc, size, offset) of stored members; it begins at offset at."""
    out = b""
    for name, crc, size, offset in members:
        raw = name.encode()
        big = zip64 or size >= MAX32 or offset >= MAX32
        extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
        short = (MAX32, MAX32) if big else (size, size)
        out += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, *short, len(raw), len(extra), 0, 0, 0, 0, MAX32 if big else offset) + raw + extra
    n, size = len(members), len(out)
    if zip64 or n >= MAX16 or size >= MAX32 or at >= MAX32:
        out += struct.pack("<IQHHIIQQQQ", EOCD64, 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<IIQI", LOCATOR64, 0, at + size, 1)
        n, size, at = MAX16, MAX32, MAX32
    return out + struct.pack("<IHHHHIIH", EOCD, 0, 0, n, n, size, at, 0)


def read_directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, stored size, offset of the local header). read(offset, length) gives bytes of the file."""
    tail_at = max(0, size - 22 - MAX16)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(struct.pack("<I", EOCD))
    while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(struct.pack("<I", EOCD), 0, k)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, length, at = struct.unpack_from("<HII", tail, k + 10)
    end = tail_at + k
    if n == MAX16 or length == MAX32 or at == MAX32:
        if end < 20:
            raise ValueError("no ZIP64 locator")
        mark, _, at64, _ = struct.unpack("<IIQI", read(end - 20, 20))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, n, length, at = struct.unpack("<IQHHIIQQQQ", read(at64, 56))
        if mark != EOCD64:
            raise ValueError("no ZIP64 end of central directory")
    raw, found, p = read(at, length), {}, 0
    for _ in range(n):
        mark, _, _, _, method, _, _, _, stored, plain, a, b, c, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, p)
        if mark != CENTRAL:
            raise ValueError("central directory is damaged")
        name = raw[p + 46 : p + 46 + a].decode()
        extra = raw[p + 46 + a : p + 46 + a + b]
        q = 0
        while q + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                r = q + 4
                if plain == MAX32:
                    r += 8
                if stored == MAX32:
                    (stored,) = struct.unpack_from("<Q", extra, r)
                    r += 8
                if offset == MAX32:
                    (offset,) = struct.unpack_from("<Q", extra, r)
            q += 4 + m
        found[name] = (method, stored, offset)
        p += 46 + a + b + c
    return found


def data_offset(read, header: int) -> int:
    """Where a member's bytes begin: its local header's name and extra lengths may differ from the directory's."""
    mark, a, b = struct.unpack("<I22xHH", read(header, 30))
    if mark != LOCAL:
        raise ValueError("local header is damaged")
    return header + 30 + a + b


# ---- WARC


def record(kind: str, page_id, url: str, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    """A record as one gzip member. A revisit has headers only; the length of its payload is in one of them."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(str(page_id))}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-ID: {quote(str(refers_to))}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and the payload of one gzip member."""
    plain = gzip.decompress(raw)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# ---- files in any store that the cluster has


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Package:
    """An open package: its members, and the records that its index lists."""

    def __init__(self, uri: str) -> None:
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        self.members = read_directory(self.read, self.file.size())

    def read(self, at: int, length: int) -> bytes:
        return self.file.read_at(length, at)

    def stored(self, name: str) -> tuple[int, int]:
        method, size, header = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: records can't be read by range")
        return data_offset(self.read, header), size

    def index(self) -> list[tuple[int, int]]:
        """(offset, length) of each record within the archive member."""
        at, size = self.stored(INDEX)
        return [(int(a), int(b)) for a, b, *_ in (x.split("\t") for x in self.read(at, size).decode().splitlines())]

    def records(self, chosen: list[tuple[int, int]] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
        base, size = self.stored(MEMBER)
        for at, length in self.index() if chosen is None else chosen:
            if at + length > size:
                raise ValueError("the index points past the archive")
            yield parse_record(self.read(base + at, length))

    def close(self) -> None:
        self.file.close()


def write_package(uri: str, rows: Iterator[bytes], zip64: bool | None = None) -> int:
    """Records to a package; the archive member is written as it comes, its header set right at the end by size and CRC kept aside."""
    import zlib

    store, path = open_store(uri)
    parts, index, at, crc = [], [], 0, 0
    for raw in rows:
        parts.append(raw)
        index.append(f"{at}\t{len(raw)}")
        at += len(raw)
        crc = zlib.crc32(raw, crc)
    lines = "\n".join(index).encode()
    first = local_header(MEMBER, crc, at)
    second = local_header(INDEX, zlib.crc32(lines), len(lines))
    offset = len(first) + at
    end = offset + len(second) + len(lines)
    with store.open_output_stream(path) as out:
        out.write(first)
        for raw in parts:
            out.write(raw)
        out.write(second)
        out.write(lines)
        out.write(directory([(MEMBER, crc, at, 0), (INDEX, zlib.crc32(lines), len(lines), offset)], end, zip64))
    return len(index)


def _writer(folder: str, limit: int):
    def run(batches):
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        rows, size = [], 0

        def flush():
            name = f"{folder}/{uuid.uuid4().hex}.wacz"
            n = write_package(name, iter(rows))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["package", "n"])

        for batch in batches:
            for x in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = (v.as_py() for v in x)
                payload = html.encode()
                rows.append(record("response" if refers_to is None else "revisit", page_id, url, payload, digest, len(payload), refers_to))
                size += len(rows[-1])
                if size >= limit:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = MIN_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages; returns a row for each: package (its place) and n (records). Done when this returns."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(payload_col), F.lit(""))
    pages = pages.select(*[pages[f"`{c}`"] for c in dict.fromkeys((id_col, url_col, payload_col))])
    source = pages.select(F.col(id_col).alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]", "").alias("url"), html.alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    # The large column stays out of the search for equal payloads.
    keys = source.select("page_id", digest.alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= least)
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("d2", F.xxhash64("digest"))
    again = keys.withColumn("d2", F.xxhash64("digest")).join(first, ["digest", "d2"]).where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    rows = source.withColumn("digest", digest)
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")
    folder = shared_path(spark, "warc")
    rows = rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    return materialize(rows.mapInArrow(_writer(folder, package_bytes), "package string, n bigint"), "packages")


def remove(packages: DataFrame) -> None:
    """Deletes the files of packages, in tasks."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = open_store(uri)
                store.delete_file(path)
            yield batch

    packages.select("package").mapInArrow(run, "package string").write.format("noop").mode("overwrite").save()


def _reader(with_payload: bool, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                package, rows, size = Package(uri), [], 0
                for headers, payload in package.records():
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"a record of {uri} has another payload than its digest says")
                    told = lambda x: None if x is None else unquote(x)
                    row = {"page_id": told(headers.get("x-page-id")), "url": headers["warc-target-uri"], "payload_bytes": len(payload) if kind == "response" else int(headers["x-payload-length"]), "payload_digest": digest, "record_type": kind, "refers_to": told(headers.get("x-refers-to-page-id"))}
                    if with_payload:
                        row["payload"] = payload.decode() if kind == "response" else None
                    rows.append(row)
                    size += len(payload) if with_payload else 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                package.close()
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


#: Packages that a task reads at most, where there are many more than tasks.
PER_TASK = 8


def read(packages: DataFrame, with_payload: bool = True, id_type: str = "bigint") -> DataFrame:
    """The records of packages (column package): page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and payload (null for revisits). The tiny rows of names are dealt over tasks by number, so that a session
    that joins small partitions can't put all packages into one."""
    fields = [("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
    ddl = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
    if with_payload:
        fields, ddl = [*fields, ("payload", pa.string())], ddl + ", payload string"
    n, least = packages.count(), int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packages.select("package").repartition(max(1, min(n, max(least, -(-n // PER_TASK)))))
    found = dealt.mapInArrow(_reader(with_payload, pa.schema(fields)), ddl)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return read(write(table(spark, sf_dir, "pages")), with_payload=False).drop("url")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
