"""WARC archives in Zstandard frames: writing, and reading back with validation.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary; then comes one frame per record, compressed
with that dictionary. The reader loads the dictionary, finds each frame's end by its block headers, decodes frame after frame, and
validates the version line, the required headers, the block's length against Content-Length, the record's end, and
blocks and payloads against their digests, in the algorithm that these name (md5, sha1, sha256 or sha512, in hexadecimal or base 32; others are
not checked, nor are payloads in chunks or in a content coding against theirs). It also reads archives of others: of version 1.0, without a
dictionary, with names of headers in any case, with records of any type and any ids; page_id and refers_to are null for foreign ids, which
record_id and refers_to_id hold as they stand. What is wrong with an archive is told by Invalid.

Equal payloads of `least` bytes or more: those with the smallest id are `response` records, all others `revisit` records
without payload that name it. Rows that share that smallest id, too, are all responses. Which payloads are repeated follows
from one aggregation by digest; only those of two rows or more are joined, broadcast when counted and few, else by a
shuffle in which Spark splits a digest that many rows share. Archives are rows (archive, content) of a table in
the shared folder, each of at most `archive_bytes` of payload (a longer record stands alone); export() writes them as
files. The reader takes any table of archives, as Spark's binaryFile source gives it.

Nulls: a null payload is empty, a null id is written as an empty one and read back as null, a null URL as `urn:none`. Repeated rows are
records of their own. Extra columns are ignored. Line breaks in URLs are written percent-encoded. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small, small_batches

#: Fixed values of the formats: magic numbers, version lines, what ends a record, names of headers, and algorithms of digests.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION, OLD_VERSION = b"WARC/1.1", b"WARC/1.0"
END = b"\r\n\r\n"
REQUIRED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
KNOWN = (*REQUIRED, "Content-Type", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Refers-To", "WARC-Profile")
ALGORITHMS = ("md5", "sha1", "sha256", "sha512")
DICTIONARY, SAMPLES = 16_384, 64  # bytes of a dictionary, and records that it is made from


class Invalid(ValueError):
    """What is wrong with an archive, and where."""


def record_id(key: int | None) -> str:
    return f"<urn:lexmill:page:{'' if key is None else key}>"


def record(key: int | None, url: str | None, payload: bytes, kind: str, digest: str, refers: int | None) -> bytes:
    """One record with its headers, block and end."""
    uri = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A").strip() or "urn:none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Refers-To", record_id(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive."""
    sample = records[:SAMPLES]
    dictionary = b""
    if len(sample) >= 8 and sum(map(len, sample)) >= 8 * 1024:
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY, sum(map(len, sample)) // 8), [x[:65_536] for x in sample]).as_bytes()
        except zstandard.ZstdError:  # too little to learn from: records serve as they are
            dictionary = b""
    dictionary = dictionary or b"".join(sample)[:DICTIONARY]
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary + b"".join(press.compress(x) for x in records)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at this place ends, by its headers."""
    if at + 5 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise Invalid(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        if at + 3 > len(data):
            raise Invalid("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise Invalid(f"a block of unknown kind at byte {at}")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise Invalid("a frame is cut off")
    return at


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, validated."""
    data = memoryview(content)
    if len(data) < 8 or struct.unpack_from("<I", data)[0] not in (SKIPPABLE, FRAME):
        raise Invalid("neither a dictionary nor a record at the beginning")
    at = 8 + struct.unpack_from("<I", data, 4)[0] if struct.unpack_from("<I", data)[0] == SKIPPABLE else 0
    if at > len(data):
        raise Invalid("the dictionary is cut off")
    dictionary = bytes(data[8:at])
    try:
        if dictionary[:4] == struct.pack("<I", FRAME):  # it may itself be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    except zstandard.ZstdError as e:
        raise Invalid(f"the dictionary can't be loaded: {e}") from e
    while at < len(data):
        end = frame_end(data, at)
        try:
            raw = open_.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise Invalid(f"the frame at byte {at} can't be decoded: {e}") from e
        yield parsed(raw, at)
        at = end


def fields(lines: list[bytes], at: int) -> dict[str, str]:
    """Headers by name, WARC's own in their usual spelling and all others in lower case. A line that begins with a space goes on with the last."""
    usual, out, last = {x.lower(): x for x in KNOWN}, {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Invalid(f"a header without a colon in the record at byte {at}")
        last = name.decode("utf-8", "replace").strip().lower()
        last = usual.get(last, last)
        out[last] = value.decode("utf-8", "replace").strip()
    return out


def parsed(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    head, found, rest = raw.partition(END)
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (VERSION, OLD_VERSION):
        raise Invalid(f"the frame at byte {at} holds no record of {VERSION.decode()} or {OLD_VERSION.decode()}")
    headers = fields(lines[1:], at)
    for name in REQUIRED:
        if name not in headers:
            raise Invalid(f"no {name} in the record at byte {at}")
    size = headers["Content-Length"]
    if not (size.isascii() and size.isdigit()) or len(rest) != int(size) + len(END) or rest[int(size) :] != END:
        raise Invalid(f"the record at byte {at} does not end where Content-Length says")
    block = rest[: int(size)]
    if not matches(block, headers.get("WARC-Block-Digest")):
        raise Invalid(f"the block at byte {at} differs from its digest")
    return headers, block


def matches(data: bytes, said: str | None) -> bool:
    """Whether data has a digest like `sha1:...`; true where there is none, or of an unknown algorithm."""
    name, _, value = (said or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ALGORITHMS or not value:
        return True
    own = hashlib.new(name, data).digest()
    return value.strip().lower() == own.hex() or value.strip().upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def http_payload(headers: dict[str, str], block: bytes) -> tuple[int, str | None, bytes]:
    """(bytes of the full payload, its digest, the payload as far as it is stored), validated. The digest is the SHA-256 of what is stored in
    full, and for revisits what the record says."""
    said, payload, http = {}, block, headers.get("Content-Type", "").lower().startswith("application/http")
    if http:
        head, _, payload = block.partition(END)
        said = fields(head.split(b"\r\n")[1:], 0) if head else {}
    size = said.get("Content-Length", "")
    size = int(size) if size.isascii() and size.isdigit() else None
    digest, name = headers.get("WARC-Payload-Digest"), headers["WARC-Record-ID"]
    if headers["WARC-Type"] == "revisit":
        return len(payload) if size is None else size, digest and digest.removeprefix("sha256:"), payload
    coded = said.get("transfer-encoding", "identity") != "identity" or said.get("content-encoding", "identity") != "identity"
    if headers["WARC-Type"] == "response" and not coded:
        if size is not None and len(payload) != size:
            raise Invalid(f"the payload of {name} differs from its length")
        if not matches(payload, digest):
            raise Invalid(f"the payload of {name} differs from its digest")
    return len(payload), hashlib.sha256(payload).hexdigest(), payload


def key_of(uri: str | None) -> int | None:
    """The id in a record's name of ours; null for an empty one and for names of others."""
    own = (uri or "").removeprefix("<urn:lexmill:page:").removesuffix(">")
    return int(own) if own.removeprefix("-").isdigit() and own.isascii() and uri == record_id(int(own)) else None


def write(df: DataFrame, key: str, url: str, payload: str, least: int = 100, archive_bytes: int = 8 << 20) -> DataFrame:
    """A table (archive, content) of all rows, in the shared folder."""
    small_batches(df.sparkSession)
    page = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256))
    groups = page.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    repeated = small(cut(groups.filter("n > 1").select("digest", "first"), "repeated"))
    rows = page.join(repeated, "digest", "left").select("key", "url", "payload", "digest", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in slices(batches, "payload", archive_bytes):
            made = [record(r["key"], r["url"], r["payload"].encode(), "response" if r["refers"] is None else "revisit", r["digest"], r["refers"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pydict({"archive": [f"part-{task:06d}-{n:06d}.warc.zst"], "content": [archive(made)]})
            n += 1

    return cut(rows.mapInArrow(run, "archive string, content binary"), "warc")


READ = "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_id string"


def read(archives: DataFrame, content: str = "content", payloads: bool = False) -> DataFrame:
    """A row for each record of each archive (READ), with the stored payload as binary if asked for. An invalid archive is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows: list[list] = [[] for _ in range(8 + payloads)]
                held = 0
                for headers, block in records(data.as_buffer().to_pybytes()):
                    size, digest, payload = http_payload(headers, block)
                    refers = headers.get("WARC-Refers-To")
                    values = [key_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"], size, digest, key_of(refers), headers["WARC-Record-ID"], refers]
                    for column, v in zip(rows, [*values, payload] if payloads else values, strict=True):
                        column.append(v)
                    held += len(payload) * payloads + 200
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [[] for _ in rows], 0
                yield batch(rows)

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in READ.split(", ")] + ["payload"]
        return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=False)], names[: len(rows)])

    return archives.select(content).mapInArrow(run, READ + ", payload binary" * payloads)


def export(archives: DataFrame, folder: str) -> int:
    """Writes each archive as a file into a folder that every executor reaches by this path; returns their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for r in b.to_pylist():
                with open(os.path.join(folder, r["archive"] + ".part"), "wb") as f:
                    f.write(r["content"])
                os.replace(f.name, os.path.join(folder, r["archive"]))
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    return archives.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
