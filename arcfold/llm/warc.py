"""WARC archives in Zstandard, written and read as rows (name, content).

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record after it is one
frame compressed with that dictionary. Of pages with equal payloads of at least `min_bytes` bytes, the one with the
smallest id is a response and the others are revisits that refer to it and carry no payload, only its digest and
length. The reader finds each frame's end from its block headers, decodes one frame per record and validates the
version line, the mandatory headers, the block length, the payload length and the digest.

Defined results: a null payload is empty; a null url has no Target-URI header; control characters in urls are
percent-encoded; rows that share the smallest id of their payload are all responses; an empty table gives no
archives; ids are integers; other columns of the input, whatever their names, take no part. The dictionary is trained
on at most `dict_rows` whole payloads, those of smallest id hash, as far as they make `dict_sample` bytes; with too
little to train on, the sample itself is the dictionary, and an empty sample gives an archive without a dictionary
frame. A record is built and checked whole in memory.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcfold.llm import runtime

DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at this many bytes.
ARCHIVE_BYTES = 4 << 20
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header line: {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _page(uri: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)>", uri)
    if not m:
        raise ValueError(f"unknown record id {uri[:40]!r}")
    return int(m[1]) if m[1] else None


def parse(raw: bytes) -> dict:
    """A record's fields, after its headers and lengths have been validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError("no WARC version line")
    h = _fields(lines)
    if missing := [n for n in REQUIRED if n not in h]:
        raise ValueError(f"missing {', '.join(missing)}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, header says {n}")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(_fields(http.split(b"\r\n")[1:])["content-length"])
    algorithm, _, digest = h["warc-payload-digest"].partition(":")
    if algorithm != "sha256" or not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError("unknown payload digest")
    kind = h["warc-type"]
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"payload of {len(payload)} bytes, header says {size}")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in h:
        raise ValueError(f"bad record of type {kind[:20]}")
    return {
        "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": size, "payload_digest": digest,
        "refers_to": _page(h["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def frame_end(raw: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its header and block headers."""
    if raw[at : at + 4] != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    flags = raw[at + 4]
    single = flags >> 5 & 1
    size = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if size + 3 > len(raw):
            raise ValueError("frame is cut off")
        block = int.from_bytes(raw[size : size + 3], "little")
        size += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    size += 4 * (flags >> 2 & 1)
    if size > len(raw):
        raise ValueError("frame is cut off")
    return size


def read_archive(raw: bytes) -> Iterator[tuple[int, dict]]:
    """(byte offset, fields) of each record."""
    import zstandard

    at, dictionary = 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == DICT_MAGIC:
        at = 8 + struct.unpack_from("<I", raw, 4)[0]
        content = raw[8:at]
        if len(content) != at - 8:
            raise ValueError("dictionary frame is cut off")
        if content[:4] == FRAME_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
    codec = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(raw):
        end = frame_end(raw, at)
        yield at, parse(codec.decompress(raw[at:end]))
        at = end


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary for these payloads."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[:size]
        return raw if len(raw) >= 8 else b""


def _write(dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
            write_checksum=True,
        )
        lead = [struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary] if dictionary else []
        parts, size, n, part = list(lead), 0, 0, TaskContext.get().partitionId()

        def archive():
            return pa.record_batch({"name": [f"pages-{part:06}-{n:06}.warc.zst"], "content": pa.array([b"".join(parts)], pa.binary())})

        for batch in batches:
            for r in batch.to_pylist():
                frame = codec.compress(record(r["page_id"], r["url"], (r["payload"] or "").encode(), r["digest"], r["refers_to"]))
                parts.append(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    parts, size, n = list(lead), 0, n + 1
        if size:
            yield archive()

    return run


def dictionary_of(rows: DataFrame, dict_rows: int, dict_bytes: int, dict_sample: int) -> bytes:
    """A dictionary for the payloads of (page_id, payload): lengths decide which ones the driver reads."""
    chosen, size = [], 0
    for r in runtime.sample(rows, F.col("page_id"), dict_rows, F.octet_length("payload").alias("n")):
        if r["n"] and size + r["n"] <= dict_sample:
            chosen.append(r["h"])
            size += r["n"]
    hashed = rows.select(F.xxhash64("page_id").alias("h"), "payload").where(F.col("h").isin(chosen))
    # Rows that share an id share its hash, so there may be more of them than were chosen.
    return train([r["payload"].encode() for r in hashed.orderBy("h", "payload").limit(dict_rows).collect()] if chosen else [], dict_bytes)


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    *,
    min_bytes: int = 100,
    dict_rows: int = 400,
    dict_bytes: int = 64 << 10,
    dict_sample: int = 8 << 20,
    level: int = 3,
) -> DataFrame:
    """(name, content): the archives of all pages."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    dictionary = dictionary_of(rows, dict_rows, dict_bytes, dict_sample)
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # A table of known size: payloads are shuffled only if there are too many repeated digests to broadcast.
    rows = rows.join(runtime.staged(first, "repeated"), "digest", "left").withColumn(
        "refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first")),
    )
    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_write(dictionary, level), "name string, content binary")


READ = pa.schema([
    ("name", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
    ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows: list[dict] = []
                for at, fields in read_archive(raw):
                    rows.append(fields | {"name": name, "offset": at} | ({} if with_payload else {"payload": None}))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, READ)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, READ)

    return run


def read_archives(archives: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """One row per record of each archive; raises ValueError for an archive that breaks the format."""
    return archives.select("name", "content").mapInArrow(
        _read(with_payload),
        "name string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary",
    )


def archive_table(pages: DataFrame, **options) -> DataFrame:
    """The archives of all pages, written in the shared folder."""
    return runtime.swept(write_archives(pages, **options), "archives")
