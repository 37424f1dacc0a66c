"""TIFF: texts stored as grey images, and a reader that emits one row per page.

The reader walks the image file directories (either byte order, any number), decodes strips or tiles that are
stored plain, in PackBits, LZW or deflate, undoes horizontal differencing, and gives the samples of every page.
The writer makes such files from bytes: 64 samples a row, 8 bits each, pages of at most `PAGE_ROWS` rows.

Defined results: a null text is empty; an empty text gives one row of zeros; equal texts give equal files whatever
their ids; an empty table gives no rows; a file that breaks the format raises ValueError, or gives one row with the
reason where `strict` is off; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arcfold.llm import runtime, textkit

WIDTH = 64
PAGE_ROWS = 4096
STRIP_ROWS = 512
TILE = 64
# Fixed values of the format: tag numbers, compression numbers, sizes of field types.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
PLANAR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {PLAIN: "plain", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END, FULL = 256, 257, 4093


def pack_bits(raw: bytes) -> bytes:
    """PackBits: runs of three bytes or more as repeats, the rest literally."""
    a = np.frombuffer(raw, np.uint8)
    cut = textkit.runs(a)
    size = np.diff(cut)
    out, lit = bytearray(), 0

    def literal(to: int) -> None:
        for i in range(lit, to, 128):
            piece = raw[i : min(i + 128, to)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for k in np.flatnonzero(size >= 3).tolist():
        literal(int(cut[k]))
        left = int(size[k])
        while left:
            n = min(left, 128)
            out.extend((257 - n if n > 1 else 0, raw[int(cut[k])]))
            left -= n
        lit = int(cut[k + 1])
    literal(len(raw))
    return bytes(out)


def unpack_bits(raw: bytes) -> bytes:
    out, i = [], 0
    while i < len(raw):
        n = raw[i]
        i += 1
        if n < 128:
            out.append(raw[i : i + n + 1])
            i += n + 1
        elif n > 128:
            out.append(raw[i : i + 1] * (257 - n))
            i += 1
    return b"".join(out)


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code; widths change one code early."""
    table = 258 + np.arange(n)  # entries when code i is written, counted from the second code
    return 9 + (table > 511) + (table > 1023) + (table > 2047)


def lzw_encode(raw: bytes) -> bytes:
    codes: list[list[int]] = [[]]
    table: dict[int, int] = {}
    w = -1
    for c in raw:
        if w < 0:
            w = c
            continue
        k = w << 8 | c
        if (nxt := table.get(k)) is not None:
            w = nxt
            continue
        codes[-1].append(w)
        table[k] = 258 + len(table)
        if len(table) + 258 > FULL:
            codes.append([])
            table = {}
        w = c
    if w >= 0:
        codes[-1].append(w)
    bits = [_bits(np.array([CLEAR]), np.array([9]))]
    for i, block in enumerate(codes):
        last = np.array([*block, END if i == len(codes) - 1 else CLEAR])
        bits.append(_bits(last, _widths(len(last))))
    return np.packbits(np.concatenate(bits)).tobytes()


def _bits(codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    b = np.unpackbits(codes.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return b[np.arange(16) >= 16 - widths[:, None]]


def lzw_decode(raw: bytes) -> bytes:
    """Codes after a clear code have known widths, so a whole table's worth is cut out of the bits at once."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    full = _widths(4096 - 258 + 2)
    ends = np.cumsum(full)
    singles = [bytes([i]) for i in range(256)]
    out: list[bytes] = []
    at, done = 0, False
    if len(bits) >= 9 and int(np.packbits(bits[:9]).view(">u2")[0] >> 7) == CLEAR:
        at = 9
    while not done and at + 9 <= len(bits):
        n = int(np.searchsorted(ends, len(bits) - at, "right"))
        have = bits[at : at + int(ends[n - 1])]
        spread = np.zeros((n, 16), np.uint8)
        spread[np.arange(16) >= 16 - full[:n, None]] = have
        codes = np.packbits(spread, axis=1).view(">u2").ravel().astype(np.int64)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        m = int(stop[0]) if len(stop) else n
        table: list[bytes | None] = [*singles, None, None]
        prev = b""
        for k, code in enumerate(codes[:m].tolist()):
            if code < len(table):
                entry = table[code]
            elif code == len(table) and prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("bad LZW code")
            if entry is None:
                raise ValueError("bad LZW code")
            if k:
                table.append(prev + entry[:1])
            out.append(entry)
            prev = entry
        if not len(stop):
            break
        at += int(ends[m])
        done = codes[m] == END
    return b"".join(out)


def compress(raw: bytes, kind: int) -> bytes:
    return {
        PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1),
        OLD_DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits,
    }[kind](raw)


def decompress(raw: bytes, kind: int) -> bytes:
    if kind not in NAMES:
        raise ValueError(f"unknown compression {kind}")
    try:
        return {PLAIN: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}[kind](raw)
    except zlib.error as e:
        raise ValueError(str(e)) from e


def write_tiff(
    payload: bytes, *, kind: int = DEFLATE, tiled: bool = False, predictor: bool = False, width: int = WIDTH,
    page_rows: int = PAGE_ROWS,
) -> bytes:
    """payload, whose length is a positive multiple of `width`, as a little-endian file of grey pages."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\x00\x00\x00\x00\x00"), 4
    for first in range(0, len(image), page_rows):
        page = image[first : first + page_rows]
        step = TILE if tiled else STRIP_ROWS
        blocks = [page[i : i + step] for i in range(0, len(page), step)]
        if tiled:
            across = -(-width // TILE)
            blocks = [np.pad(
                b[:, TILE * j : TILE * (j + 1)], ((0, TILE - len(b)), (0, max(0, TILE * (j + 1) - width))),
            ) for b in blocks for j in range(across)]
        places, sizes = [], []
        for b in blocks:
            if predictor:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            raw = compress(b.tobytes(), kind)
            places.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\x00" * (len(raw) % 2)
        fields = {
            IMAGE_WIDTH: [width], IMAGE_LENGTH: [len(page)], BITS: [8], COMPRESSION: [kind], PHOTOMETRIC: [1],
            SAMPLES: [1], PREDICTOR: [2 if predictor else 1],
        }
        fields |= {
            TILE_WIDTH: [TILE], TILE_LENGTH: [TILE], TILE_OFFSETS: places, TILE_COUNTS: sizes,
        } if tiled else {STRIP_OFFSETS: places, ROWS_PER_STRIP: [STRIP_ROWS], STRIP_COUNTS: sizes}
        entries = b""
        for tag, values in sorted(fields.items()):
            data = struct.pack(f"<{len(values)}I", *values)
            if len(data) > 4:
                place = len(out)
                out += data
                data = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, 4, len(values)) + data
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\x00\x00\x00\x00"
    return bytes(out)


def _directory(raw: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(f"{order}H", raw, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * i)
        size = FIELD_BYTES.get(kind)
        if size is None:
            continue
        place = at + 10 + 12 * i
        if size * count > 4:
            (place,) = struct.unpack_from(f"{order}I", raw, place)
        if place + size * count > len(raw):
            raise ValueError("a field lies outside the file")
        if kind in (1, 3, 4):
            fields[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", raw, place))
    return fields, struct.unpack_from(f"{order}I", raw, at + 2 + 12 * n)[0]


def read_tiff(raw: bytes) -> Iterator[dict]:
    """Every page: number, width, height, samples, compression and its samples, row by row."""
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(raw[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    try:
        (at,) = struct.unpack_from(f"{order}I", raw, 4)
        seen: set[int] = set()
        while at:
            if at in seen:
                raise ValueError("the directories form a loop")
            seen.add(at)
            f, at = _directory(raw, at, order)
            yield {"page": len(seen) - 1, **_page(raw, f)}
    except struct.error as e:
        raise ValueError(f"the file is cut off: {e}") from e


def _page(raw: bytes, f: dict[int, list[int]]) -> dict:
    get = lambda tag, default: f.get(tag, [default])[0]
    if IMAGE_WIDTH not in f or IMAGE_LENGTH not in f:
        raise ValueError("a page without a size")
    width, height, samples, kind = get(IMAGE_WIDTH, 0), get(IMAGE_LENGTH, 0), get(SAMPLES, 1), get(COMPRESSION, PLAIN)
    if set(f.get(BITS, [8])) != {8} or get(PLANAR, 1) != 1:
        raise ValueError("only interleaved samples of 8 bits are read")
    tiled = TILE_OFFSETS in f
    bw, bh = (get(TILE_WIDTH, 0), get(TILE_LENGTH, 0)) if tiled else (width, min(get(ROWS_PER_STRIP, height), height))
    places, sizes = (f.get(t, []) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    across, down = -(-width // max(bw, 1)), -(-height // max(bh, 1))
    if len(places) != across * down or len(sizes) != len(places):
        raise ValueError(f"{len(places)} blocks for {across * down} places")
    image = np.zeros((down * bh, across * bw, samples), np.uint8)
    for i, (p, n) in enumerate(zip(places, sizes, strict=True)):
        if p + n > len(raw):
            raise ValueError("a block lies outside the file")
        y, x = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, height - y)
        data = np.frombuffer(decompress(raw[p : p + n], kind), np.uint8)
        if len(data) < rows * bw * samples:
            raise ValueError("a block is too short")
        block = data[: rows * bw * samples].reshape(rows, bw, samples)
        if get(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        elif get(PREDICTOR, 1) != 1:
            raise ValueError("unknown predictor")
        image[y : y + rows, x : x + bw] = block
    return {
        "width": width, "height": height, "samples": samples,
        "compression": NAMES[kind] + ("+tiles" if tiled else "") + ("+differences" if get(PREDICTOR, 1) == 2 else ""),
        "pixels": image[:height, :width].tobytes(),
    }


def layout(payload: bytes) -> dict:
    """How a payload is stored: mostly in deflated strips, by its checksum sometimes otherwise."""
    k = zlib.crc32(payload) % 8
    return {
        0: {"kind": LZW, "tiled": True, "predictor": False}, 1: {"kind": PACKBITS},
        2: {"kind": DEFLATE, "predictor": True}, 3: {"kind": DEFLATE, "tiled": True},
    }.get(k, {"kind": DEFLATE})


def _store(text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches, text_col):
            data, off = textkit.flat(batch.column(text_col))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            padded = [t + b"\x00" * ((-len(t)) % WIDTH if t else WIDTH) for t in texts]
            media = pa.array([write_tiff(p, **layout(p)) for p in padded], pa.binary())
            yield pa.record_batch([media if c == "media" else pa.array(np.diff(off)) if c == "n_bytes" else batch.column(c) for c in names], names)

    return run


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with their texts as TIFF files: n_bytes and media instead of text_col."""
    docs = runtime.without(docs, "n_bytes", "media")
    rest = docs.drop(text_col)
    return docs.mapInArrow(
        _store(text_col, [*rest.columns, "n_bytes", "media"]),
        ", ".join(x for x in (_ddl(rest), "n_bytes long", "media binary") if x),
    )


PAGE = {
    "page": pa.int64(), "width": pa.int64(), "height": pa.int64(), "samples": pa.int64(), "compression": pa.string(),
    "pixels": pa.binary(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "error": pa.string(),
}


def _read(media_col: str, names: list[str], strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch, of, rows):
            cols = batch.select(names).take(pa.array(of, pa.int64()))
            return pa.record_batch([*cols.columns, *(pa.array([r.get(n) for r in rows], t) for n, t in PAGE.items())], [*names, *PAGE])

        for batch in textkit.chunks(batches, media_col):
            of, rows, size = [], [], 0
            for i, raw in enumerate(batch.column(media_col).to_pylist()):
                media = {"media_bytes": len(raw or b""), "media_sha256": hashlib.sha256(raw or b"").hexdigest()}
                try:
                    for page in read_tiff(raw or b""):
                        of.append(i)
                        rows.append(page | media)
                        size += len(page["pixels"])
                        if size > 8 << 20:
                            yield out(batch, of, rows)
                            of, rows, size = [], [], 0
                except ValueError as e:
                    if strict:
                        raise
                    of.append(i)
                    rows.append(media | {"error": str(e)})
            yield out(batch, of, rows)

    return run


def read_pages(files: DataFrame, media_col: str = "media", *, strict: bool = True) -> DataFrame:
    """One row per page of each file: the other columns of the file, then page, width, height, samples, compression,
    pixels, media_bytes, media_sha256 and error. The pages of a file follow one another in one partition."""
    files = runtime.without(files, *PAGE)
    rest = files.drop(media_col)
    added = "page long, width long, height long, samples long, compression string, pixels binary, media_bytes long, media_sha256 string, error string"
    return files.mapInArrow(_read(media_col, rest.columns, strict), ", ".join(x for x in (_ddl(rest), added) if x))


DIGEST = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
    "media_sha256": pa.string(), "feature": pa.string(),
}


def _digest(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        now: dict | None = None

        def close() -> None:
            if now:
                mean = now["sum"] / max(now["n"], 1)
                rows.append(now["keep"] | {
                    "payload_bytes": now["n"], "payload_sha256": now["sha"].hexdigest(),
                    "tail_crc32": zlib.crc32(now["tail"]),
                    "feature": f"pages={now['pages']};rows={now['rows']};{now['how']};mean={mean:.4f};bytes={now['kinds'].astype(bool).sum()}",
                })

        for batch in batches:
            for r in batch.to_pylist():
                if r["page"] != (now["pages"] if now and r["page"] else 0):
                    raise ValueError("the pages of a file don't follow one another")
                if r["page"] == 0:
                    close()
                    now = {
                        "keep": {n: r[n] for n in (*names, "media_bytes", "media_sha256")}, "sha": hashlib.sha256(),
                        "n": 0, "sum": 0, "pages": 0, "rows": 0, "tail": b"", "how": r["compression"],
                        "kinds": np.zeros(256, np.int64),
                    }
                px = r["pixels"]
                a = np.bincount(np.frombuffer(px, np.uint8), minlength=256)
                now["sha"].update(px)
                now["n"] += len(px)
                now["pages"] += 1
                now["rows"] += r["height"]
                now["sum"] += int((a * np.arange(256)).sum())
                now["kinds"] += a
                now["tail"] = (now["tail"] + px[-64:])[-64:]
            done, rows[:] = rows[:], []
            yield pa.RecordBatch.from_pylist(done, pa.schema([*((n, batch.schema.field(n).type) for n in names), *DIGEST.items()]))
        last = now
        close()
        if last:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*((n, batch.schema.field(n).type) for n in names), *DIGEST.items()]))

    return run


def page_digests(pages: DataFrame, *names: str) -> DataFrame:
    """Per file of read_pages(): the named columns, and digests of its samples over all its pages."""
    cols = pages.select(*names, "page", "height", "compression", "pixels", "media_bytes", "media_sha256")
    return cols.mapInArrow(
        _digest(list(names)),
        f"{_ddl(pages.select(*names))}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
