"""WARC records in ZIP packages: written as a Spark job, read back by ranges without extraction.

A package holds three stored (uncompressed) members: ``archive/data.warc.gz`` (one gzip member for each record),
``indexes/index.cdxj`` (a line for each record with its place) and ``datapackage.json``. Each task writes packages of about ``PACKAGE_BYTES``
under a temporary name and renames them when complete, so a task that is run again leaves whole files only.

The reader takes a package's end record from its last bytes, follows the ZIP64 locator where there is one, parses the
central directory, finds the stored members' data through their local headers, reads the index, and fetches runs of
records of at most ``RANGE_BYTES`` each. Members that are compressed are refused: a range of them means nothing. Packages of others
are read as well: any record type and record id, numbers written as strings, gzipped indexes, plain or gzipped records, HTTP
bodies without length or in chunks, and digests of other algorithms (``verified`` is null where the algorithm isn't known or the
record has no digest). ``page_id`` and ``refers_to`` are those of our own ids (``urn:page:``), null for others.

Defined results: a null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are always responses; of rows that
repeat the smallest page_id all are responses; a row without page_id is written with an empty id, is never referred to and
is a response unless another page holds its payload; a null url is left out; long pages are records like any other. Empty tables
give no packages and no rows. Columns of the input other than id, url and html are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Saved, bounded_batches, fresh_path, sized, slices

MIN_REVISIT = 100
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Reading tasks for each core at most; a task reads several packages beyond that.
READERS = 16
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
        T.StructField("package", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("verified", T.BooleanType()), T.StructField("record_id", T.StringType()), T.StructField("refers_to_id", T.StringType()),
    ]
)
_PACKAGES = T.StructType([T.StructField("package", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep}


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload (the body, or the whole block of records that aren't HTTP) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    warc = _fields(lines)
    block = rest[: int(warc["content-length"])]
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, block
    http_head, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http_head.decode("utf-8", "replace").split("\r\n")[1:]), payload


def unchunked(body: bytes) -> bytes:
    """A body in chunks put together; what isn't in chunks stays."""
    out, at = [], 0
    while found := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, at):
        size = int(found[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[found.end() : found.end() + size])
        at = found.end() + size + 2
    return body


def digest_holds(digest: str | None, payload: bytes) -> bool | None:
    """Whether ``algorithm:value`` (hexadecimal or base 32) is the payload's digest; null if that can't be told."""
    name, _, value = (digest or "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found = hashlib.new(name, payload).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def _own_id(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", name or "")
    return int(found[1]) if found else None


class PackageWriter:
    """Stored members one after another; ZIP64 fields wherever a size, place or count asks for them (or always)."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def store(self, name: str, parts: list[bytes]) -> int:
        """Adds a member; returns where its data begins."""
        crc, size, where, raw = 0, sum(map(len, parts)), self.at, name.encode()
        for part in parts:
            crc = zlib.crc32(part, crc)
        big = self.zip64 or size >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = 0xFFFFFFFF if big else size
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x5821, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        data_at = self.at
        for part in parts:
            self._put(part)
        self.members.append((raw, crc, size, where))
        return data_at

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, where in self.members:
            values = []
            shown, place = size, where
            if self.zip64 or size >= 0xFFFFFFFF:
                values += [size, size]
                shown = 0xFFFFFFFF
            if self.zip64 or where >= 0xFFFFFFFF:
                values.append(where)
                place = 0xFFFFFFFF
            extra = struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if values else 20, 0x800, 0, 0, 0x5821, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.zip64 or begin >= 0xFFFFFFFF or n >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin) + struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            n, size, begin = min(n, 0xFFFF), 0xFFFFFFFF, 0xFFFFFFFF
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, begin, 0))


def directory(source, length: int) -> dict[str, tuple[int, int, int]]:
    """(method, size, place of the local header) of each member, from the central directory. ``source`` has read_at(n, at)."""
    tail_at = max(0, length - 22 - 0xFFFF)
    tail = source.read_at(length - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    n, size, begin = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if locator >= 0 and (found := source.read_at(20, locator))[:4] == b"PK\x06\x07":
        (at,) = struct.unpack("<Q", found[8:16])
        big = source.read_at(56, at)
        if big[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator leads nowhere")
        n, size, begin = struct.unpack("<QQQ", big[32:56])
    data, at, out = source.read_at(size, begin), 0, {}
    for _ in range(n):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack("<H", data[at + 10 : at + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        (place,) = struct.unpack("<I", data[at + 42 : at + 46])
        name, extra = data[at + 46 : at + 46 + n_name], data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:
                values = list(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                place = values.pop(0) if place == 0xFFFFFFFF else place
            extra = extra[4 + width :]
        out[name.decode()] = (method, packed, place)
        at += 46 + n_name + n_extra + n_note
    return out


def data_range(source, member: tuple[int, int, int]) -> tuple[int, int]:
    """Where a stored member's bytes begin, and how many they are."""
    method, size, place = member
    if method:
        raise ValueError(f"the member is compressed (method {method}); only stored members can be read by range")
    head = source.read_at(30, place)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header where the central directory says")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return place + 30 + n_name + n_extra, size


def _entries(data: bytes) -> list[dict]:
    """Lines of an index, gzipped or not, that have a place; header lines are passed over."""
    text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()
    rows = [json.loads(line[line.index("{") :]) for line in text.split("\n") if "{" in line and not line.startswith("!")]
    return [{"filename": r["filename"], "offset": int(r["offset"]), "length": int(r["length"])} for r in rows if "offset" in r and "length" in r]


def _described(data: bytes) -> dict:
    """One record, gzipped or not."""
    warc, http, payload = parse_record(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    revisit = warc.get("warc-type") == "revisit"
    digest = warc.get("warc-payload-digest") or (None if http else warc.get("warc-block-digest"))
    verified = None if revisit else digest_holds(digest, payload)
    if not revisit and "chunked" in http.get("transfer-encoding", "").lower():
        plain = unchunked(payload)
        payload, verified = plain, None if verified is None else verified or digest_holds(digest, plain)
    stated = http.get("content-length", "")
    size = (int(stated) if stated.isdigit() else None) if revisit else len(payload)
    bare = digest.partition(":")[2] if digest else None
    return {
        "page_id": _own_id(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "record_type": warc.get("warc-type"), "refers_to": _own_id(warc.get("warc-refers-to")) if revisit else None,
        "payload_bytes": size, "payload_digest": bare, "payload": None if revisit else payload, "verified": bool(digest) if revisit else verified,
        "record_id": warc.get("warc-record-id"), "refers_to_id": warc.get("warc-refers-to"),
    }


def read_package(source, length: int, package: str) -> Iterator[dict]:
    """All records of one package, through its index."""
    members = directory(source, length)
    places = {name: data_range(source, m) for name, m in members.items() if name.startswith(("archive/", "indexes/")) and not name.endswith(("/", ".idx"))}
    entries = [e for name, (at, size) in places.items() if name.startswith("indexes/") for e in _entries(source.read_at(size, at))]
    entries.sort(key=lambda e: (e["filename"], e["offset"]))
    i = 0
    while i < len(entries):
        name, begin = entries[i]["filename"], entries[i]["offset"]
        j, end = i, begin
        while j < len(entries) and entries[j]["filename"] == name and (j == i or entries[j]["offset"] + entries[j]["length"] - begin <= RANGE_BYTES):
            end = max(end, entries[j]["offset"] + entries[j]["length"])
            j += 1
        at = places[name] if name in places else places[f"archive/{name}"]
        block = source.read_at(end - begin, at[0] + begin)
        for e in entries[i:j]:
            yield _described(block[e["offset"] - begin : e["offset"] - begin + e["length"]]) | {"package": package, "offset": e["offset"]}
        i = j


def write_packages(pages: DataFrame, to: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes every row of ``pages`` into packages under ``to``; package, records and bytes of each."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.encode(html, "utf-8"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.sha2(payload, 256).alias("digest"), F.col(html).alias("html"))
    # the responses that others revisit: one row for each payload that occurs twice or more
    long = rows.filter(F.octet_length("html") >= MIN_REVISIT)
    held = Saved(long.groupBy("digest").agg(F.min("page_id").alias("held"), F.count("*").alias("n")).filter("n > 1").select("digest", "held"), "payloads")
    linked = rows.join(sized(held.df, held.count()), "digest", "left").select("page_id", "url", "digest", "html", "held")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(to)
        lines: list[tuple[str, dict]] = []
        parts: list[bytes] = []
        size = 0

        def flush():
            name = f"{uuid.uuid4().hex}.wacz"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/.{name}") as out:
                zipped = PackageWriter(out)
                zipped.store("archive/data.warc.gz", parts)
                index = "".join(f"{key} {_DATE[:10].replace('-', '')}000000 {json.dumps(x)}\n" for key, x in sorted(lines, key=lambda x: (x[0], x[1]["offset"])))
                zipped.store("indexes/index.cdxj", [index.encode()])
                zipped.store("datapackage.json", [json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "records": len(lines)}).encode()])
                zipped.close()
            store.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{to}/{name}"]), pa.array([len(lines)], pa.int64()), pa.array([zipped.at], pa.int64())], names=_PACKAGES.names)

        for batch in batches:
            for piece in slices(batch, 3, 2 << 20):
                for page, target, digest, text, held in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    body = (text or "").encode()
                    revisit = held is not None and page != held
                    data = gzip.compress(record(page, target, body, digest, held, revisit), 4, mtime=0)
                    key = json.dumps(target or "")[1:-1].replace(" ", "%20") or "-"
                    lines.append((key, {"url": target, "digest": f"sha256:{digest}", "filename": "data.warc.gz", "offset": size, "length": len(data)}))
                    parts.append(data)
                    size += len(data)
                    if size >= PACKAGE_BYTES:
                        yield flush()
                        lines, parts, size = [], [], 0
        if lines:
            yield flush()

    packages = Saved(linked.mapInArrow(run, _PACKAGES), "packages").df
    held.drop()
    return packages


def read_packages(spark: SparkSession, packages: DataFrame, package: str = "package", payloads: bool = True) -> DataFrame:
    """The records (``RECORDS``) of all packages that ``packages`` names, one package after another in each task."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = pafs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    source = _Ranges(f)
                    kept: list[dict] = []
                    weight = 0
                    for r in read_package(source, f.size(), path):
                        weight += len(r["payload"] or b"") + 500
                        if not payloads:
                            r["payload"] = None
                        kept.append(r)
                        if weight > RANGE_BYTES:
                            yield _batch(kept)
                            kept, weight = [], 0
                    if kept:
                        yield _batch(kept)

    most = READERS * spark.sparkContext.defaultParallelism
    return packages.select(F.col(package)).repartition(max(1, min(packages.count(), most))).mapInArrow(run, RECORDS)


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("package", pa.string()), ("offset", pa.int64()), ("verified", pa.bool_()), ("record_id", pa.string()), ("refers_to_id", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Ranges:
    """Reads by range from an open Arrow file."""

    def __init__(self, f):
        self.f = f

    def read_at(self, n: int, at: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)


class Memory(_Ranges):
    """The same over bytes, for tests."""

    def __init__(self, data: bytes):
        super().__init__(io.BytesIO(data))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into packages in the shared folder and reads all records back, without their payloads."""
    spark = pages.sparkSession
    return read_packages(spark, write_packages(pages, fresh_path(spark, "archives")), payloads=False)
