"""TIFF as a media column: a writer, and a reader that walks image directories.

The reader takes either byte order, strips and tiles, no compression, PackBits, LZW or deflate, and
undoes horizontal differencing; it gives one page at a time. Samples are 8-bit and in one plane.

Defined cases: a null file gives no pages; a file that isn't TIFF, is cut short, loops through its
directories, claims more samples than its stored bytes can hold or than ``MOST_BYTES`` a page, or uses what
isn't supported raises ValueError (from ``tiff_pages``: one row with ``error``, behind the pages before the
fault); null and empty texts are stored as one row of padding; equal payloads give equal files; very long
texts become several pages; an empty table gives no rows; repeated rows stay rows. ``tiff_pages`` passes
extra columns on, but for those with the names of its results; ``store_texts`` reads key and text alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociscale.llm.common import replaced, small_batches, spread

#: Fixed values of the format: tags, field sizes, compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST = 256, 257, 258

#: The most bytes that a stored byte can stand for, by compression: a literal, a run of 128 in two bytes, the
#: longest string of a full table in 12 bits, and deflate's limit.
MOST_GAIN = {NONE: 1, PACKBITS: 64, LZW: 2_600, DEFLATE: 1_040, OLD_DEFLATE: 1_040}
#: The most samples of a page, a strip or a tile: what a reader allocates whatever a header says.
MOST_BYTES = 1 << 28


# --- compression ---------------------------------------------------------------------------------


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as (1 - n, byte), the rest as literals of up to 128 bytes."""
    out, at = bytearray(), 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            own = part[i : i + 128]
            out.append(len(own) - 1)
            out.extend(own)

    for m in re.finditer(rb"(.)\1{2,}", data, re.S):
        literal(data[at : m.start()])
        n = m.end() - m.start()
        while n > 1:
            k = min(n, 128)
            out.extend(((257 - k) & 255, data[m.start()]))
            n -= k
        at = m.end() - n
    literal(data[at:])
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _code_widths(places: np.ndarray) -> np.ndarray:
    """Bits of the codes at these places behind a clear code: each width changes one code early."""
    return 9 + np.searchsorted((512, 1024, 2048), places + FIRST, side="right")


def lzw_encode(data: bytes) -> bytes:
    """Variable-width codes, high bit first. The table is of pairs of a string's code and the byte behind it."""
    codes, table, upto = [CLEAR], {}, FIRST
    if data:
        code, find, add = data[0], table.get, codes.append
        for byte in memoryview(data)[1:]:
            pair = code << 8 | byte
            longer = find(pair)
            if longer is not None:
                code = longer
                continue
            add(code)
            table[pair] = upto
            upto += 1
            code = byte
            if upto == 4094:
                add(CLEAR)
                table.clear()
                upto = FIRST
        add(code)
    codes.append(END)
    own = np.array(codes, dtype=np.int64)
    cleared = np.flatnonzero(own == CLEAR)
    since = np.arange(len(own)) - np.repeat(cleared, np.diff(np.append(cleared, len(own)))) - 1
    since[cleared[1:]] = since[cleared[1:] - 1] + 1  # a clear code is the last of its run
    since[0] = 0
    return _pack(own, _code_widths(since))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1]), dtype=np.uint8)
    for k in range(12):  # bit k from the low end
        has = widths > k
        bits[ends[has] - 1 - k] = (codes[has] >> k) & 1
    return np.packbits(bits).tobytes()


#: Codes behind a clear code that are cut out of the bits at a time, where each begins, and its bits.
RUN = 4096
_WIDTHS = _code_widths(np.arange(RUN))
_BEGIN = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw_decode(data: bytes, size: int) -> bytes:
    """The codes up to the next clear code are cut out at once, since their widths follow from their places."""
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    parts: list[bytes] = []
    table, before, made, at, bits = list(base), b"", 0, 0, 8 * len(data)
    place = 0  # behind the last clear code; past RUN all codes have 12 bits
    while at + 9 <= bits and made < size:
        begin, widths = (_BEGIN, _WIDTHS) if place == 0 else (np.arange(RUN + 1) * 12, np.full(RUN, 12))
        n = int(np.searchsorted(begin, bits - at, side="right")) - 1
        from_ = at + begin[:n]
        byte, wide = from_ >> 3, widths[:n]
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (from_ & 7) - wide) & ((1 << wide) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        upto = int(stops[0]) if len(stops) else n
        for code in codes[:upto].tolist():
            if not before:
                own = table[code] if code < 256 else b""
            else:
                if code < len(table):
                    own = table[code]
                elif code == len(table):
                    own = before + before[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                if len(table) < RUN:
                    table.append(before + own[:1])
            parts.append(own)
            made += len(own)
            before = own
        if upto == n:  # neither a clear nor an end code
            if n < RUN:
                break
            at, place = at + int(begin[n]), place + n
        elif codes[upto] == END:
            break
        else:
            at, place, table, before = at + int(begin[upto + 1]), 0, list(base), b""
    return b"".join(parts)


def compress(data: bytes, scheme: int) -> bytes:
    deflate = lambda x: zlib.compress(x, 6)
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: deflate, OLD_DEFLATE: deflate, PACKBITS: packbits_encode}[scheme](data)


def decompress(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        out = data
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, max(1, size))
        except zlib.error as e:
            raise ValueError(f"deflate: {e}") from e
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {scheme} is not supported")
    if len(out) < size:
        raise ValueError("image data is cut short")
    return out[:size]


# --- reading -------------------------------------------------------------------------------------


@dataclass
class Page:
    """One image: its samples are uint8 in an array of height, width, samples."""

    number: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def pages(data: bytes) -> Iterator[Page]:
    """The images of a file, in the order of its directories."""
    if data[:4] == b"II*\0":
        order = "<"
    elif data[:4] == b"MM\0*":
        order = ">"
    else:
        raise ValueError("not a TIFF file")

    def get(kind: str, at: int) -> tuple:
        if at + struct.calcsize(order + kind) > len(data):
            raise ValueError("the file is cut short")
        return struct.unpack_from(order + kind, data, at)

    def values(kind: int, n: int, at: int) -> tuple[int, ...]:
        size = FIELD_BYTES.get(kind, 0) * n
        start = at if size <= 4 else get("I", at)[0]
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        return get(f"{n}{code}", start) if code else ()

    (at,), seen, number = get("I", 4), set(), 0
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (n,) = get("H", at)
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, kind, count = get("HHI", at + 2 + 12 * i)
            tags[tag] = values(kind, count, at + 10 + 12 * i)
        yield _page(number, tags, data)
        number += 1
        (at,) = get("I", at + 2 + 12 * n)


def _page(number: int, tags: dict[int, tuple[int, ...]], data: bytes) -> Page:
    one = lambda tag, default=None: (tags.get(tag) or (default,))[0]
    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    if not width or not height or not samples or set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1 and samples > 1:
        raise ValueError("only 8-bit samples in one plane are supported")
    scheme, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    tiled = TILE_OFFSETS in tags
    wide, high = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ()))
    if not wide or not high or len(offsets) != len(counts) or len(offsets) < -(-width // wide) * -(-height // high):
        raise ValueError("the strips or tiles don't cover the image")
    if scheme not in MOST_GAIN:
        raise ValueError(f"compression {scheme} is not supported")
    if max(width * height, wide * high) * samples > MOST_BYTES:
        raise ValueError(f"a page, strip or tile of more than {MOST_BYTES} bytes")
    if width * height * samples > sum(counts) * MOST_GAIN[scheme]:
        raise ValueError("the stored bytes can't hold that many samples")
    pixels = np.empty((height, width, samples), dtype=np.uint8)
    across = -(-width // wide)
    for i, (start, count) in enumerate(zip(offsets, counts, strict=True)):
        top, left = i // across * high, i % across * wide
        if top >= height:
            break
        rows = high if tiled else min(high, height - top)
        if start + count > len(data):
            raise ValueError("the file is cut short")
        part = np.frombuffer(decompress(data[start : start + count], scheme, rows * wide * samples), dtype=np.uint8).reshape(rows, wide, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is not supported")
        pixels[top : top + rows, left : left + wide] = part[: height - top, : width - left]
    return Page(number, width, height, samples, scheme, predictor, tiled, pixels)


# --- writing -------------------------------------------------------------------------------------


def write(images: list[np.ndarray], *, scheme: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 64, order: str = "<") -> bytes:
    """A file with a page for each image (uint8: height, width, samples)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    for image in images:
        height, width, samples = image.shape
        high, wide = tile or (min(rows_per_strip, height), width)
        offsets, counts = [], []
        for top in range(0, height, high):
            for left in range(0, width, wide):
                part = image[top : top + high, left : left + wide]
                if tile:
                    part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                packed = compress(part.tobytes(), scheme)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        fields = {WIDTH: (width,), LENGTH: (height,), BITS: (8,) * samples, COMPRESSION: (scheme,), PHOTOMETRIC: (2 if samples == 3 else 1,), SAMPLES: (samples,), PLANAR: (1,), PREDICTOR: (predictor,)}
        fields |= {TILE_WIDTH: (wide,), TILE_LENGTH: (high,), TILE_OFFSETS: tuple(offsets), TILE_COUNTS: tuple(counts)} if tile else {ROWS_PER_STRIP: (high,), STRIP_OFFSETS: tuple(offsets), STRIP_COUNTS: tuple(counts)}
        entries = b""
        for tag, own in sorted(fields.items()):
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4
            packed = struct.pack(f"{order}{len(own)}{'H' if kind == 3 else 'I'}", *own)
            if len(packed) > 4:
                where = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(own)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- texts as media ------------------------------------------------------------------------------

UNIT, PAGE_ROWS = 576, 4096
#: By checksum of the payload, in equal shares: all that the reader knows. Tiles are a third of a row wide.
FORMS = list(product((NONE, PACKBITS, LZW, DEFLATE, OLD_DEFLATE), (1, 2), (None, (16, UNIT // 3)), "<>"))


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\xff")


def text_to_tiff(payload: bytes) -> bytes:
    """Rows of 576 samples, in pages of 4096 rows at most."""
    image = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT, 1)
    scheme, predictor, tile, order = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write([image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)], scheme=scheme, predictor=predictor, tile=tile, order=order)


def _columns(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def text_files(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text as a TIFF file: doc_id, n_bytes, media_bytes, media_sha256, content."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, content binary"

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, payload = payload_of(own)
                media = text_to_tiff(payload)
                rows.append((doc, n, len(media), hashlib.sha256(media).hexdigest(), media))
            yield _batch(rows, _columns(schema))

    return spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(filed, schema)


def store_texts(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text through a TIFF file and ``tiff_pages`` back: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, n_pages. A file's pages follow one another in their task,
    so they are folded as they come. A file that can't be read back raises."""
    read = tiff_pages(text_files(docs, text=text, key=key))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    columns = _columns(schema)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, digest, size, tail, count, total, peak, shape = None, None, 0, b"", 0, 0, 0, ""

        def row() -> tuple:
            doc, n, media, sha = file
            return doc, n, size, digest.hexdigest(), zlib.crc32(tail), media, sha, f"{count} {shape} mean={total / size:.4f} max={peak}", count

        for batch in batches:
            rows = []
            named = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "width", "height", "samples", "compression", "predictor", "tiled", "error", "pixels")]
            for doc, n, media, sha, page, width, height, samples, scheme, predictor, tiled, error, pixels in zip(*(c.to_pylist() for c in named), strict=True):
                if error:
                    raise ValueError(f"document {doc}: {error}")
                if page == 0:
                    if file:
                        rows.append(row())
                    file, digest, size, tail, count, total, peak = (doc, n, media, sha), hashlib.sha256(), 0, b"", 0, 0, 0
                own = np.frombuffer(pixels, dtype=np.uint8)
                digest.update(pixels)
                size, tail, count = size + len(own), (tail + pixels[-32:])[-32:], count + 1
                total, peak = total + int(own.sum(dtype=np.int64)), max(peak, int(own.max()))
                shape = f"{width}x{height}x{samples} c{scheme} p{predictor} {'tiles' if tiled else 'strips'}"
            yield _batch(rows, columns)
        if file:
            yield _batch([row()], columns)

    return read.mapInArrow(folded, schema)


def tiff_pages(files: DataFrame, *, content: str = "content") -> DataFrame:
    """One row for each page: the columns of ``files`` but ``content``, then page, width, height, samples,
    compression, predictor, tiled, pixels (binary, rows from the top) and error."""
    small_batches(files.sparkSession)
    names = [c for c in files.columns if c != content]
    added = {"page": "int", "width": "int", "height": "int", "samples": "int", "compression": "int", "predictor": "int", "tiled": "boolean", "pixels": "binary", "error": "string"}
    plain = replaced(files.select(*[f"`{c}`" for c in names]), **{k: F.lit(None).cast(v) for k, v in added.items()})
    outer = plain.columns
    kept = outer[: -len(added)]
    kinds = [k for _, k in _columns(", ".join(f"{k} {v}" for k, v in added.items()))]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, *[pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=outer)  # noqa: B023

            for i, data in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = pages(data) if data is not None else iter(())
                while True:
                    try:
                        page = next(found, None)
                        row = None if page is None else (page.number, page.width, page.height, page.samples, page.compression, page.predictor, page.tiled, page.pixels.tobytes(), None)
                    except (ValueError, MemoryError) as e:
                        page, row = None, (None,) * 8 + (str(e) or "out of memory",)
                    if row:
                        at.append(i)
                        rows.append(row)
                        held += len(row[7] or b"")
                    if held > 1 << 22:
                        yield out()
                        at, rows, held = [], [], 0
                    if page is None:
                        break
            if rows:
                yield out()

    return files.select(*[f"`{c}`" for c in kept], F.col(content)).mapInArrow(walked, plain.schema)
