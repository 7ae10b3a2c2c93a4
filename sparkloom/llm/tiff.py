"""TIFF as a media column: a reader that emits one row per page, and a writer for lossless 8-bit samples.

The reader walks the chain of image directories of either byte order, of TIFF and BigTIFF, decodes strips and tiles stored
plainly or as PackBits, LZW or deflate, by pixel or by plane, undoes the horizontal predictor, and crops tiles to the page.
Samples have 1, 4, 8 or 16 bits; those of 1 and 4 bits become bytes, those of 16 bits little-endian pairs of bytes.

Defined results: a null or empty media value, and one that is not TIFF, give no page; a page that is not supported or is damaged
(strips or tiles that are missing, too short or beyond the end, sizes of 0, more samples than its data can hold) gives a row whose
``error`` tells why, with null samples, and the walk goes on; a damaged directory gives one such row and ends the walk, as does
a loop of directories without a row. Columns of the input with the names of page columns are replaced.

Not supported: other bit depths and samples of mixed depth, floating-point samples, the predictor with 1 or 4 bits, other
predictors and compressions (CCITT, JPEG).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: tags, field widths and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
FILL_ORDER, PLANES, SAMPLE_FORMAT = 266, 284, 339
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes that one stored byte may become, at most.
GROWTH = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
_MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))

#: Payloads are padded with PAD to a positive multiple of UNIT, which is also the width of a stored page.
UNIT, PAD = 576, 255
PAGE_ROWS = 64


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 2:
            out += bytes((257 - (j - i), data[i]))
            i = j
            continue
        while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    table: list[bytes] = []
    out, last, width, held, have = bytearray(), b"", 9, 0, 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have & (1 << width) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, last, width = [bytes((k,)) for k in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("LZW data does not begin with a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, (len(table) + 1).bit_length()) if len(table) + 1 >= 512 else 9
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    value = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal value, bits
        value, bits = value << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(value >> bits & 255)
        value &= (1 << bits) - 1

    codes, free, width, run = {bytes((k,)): k for k in range(256)}, 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        byte = data[k : k + 1]
        if run + byte in codes:
            run += byte
            continue
        put(codes[run], width)
        codes[run + byte] = free
        free += 1
        run = byte
        if free >= 4094:
            put(256, width)
            codes, free, width = {bytes((k,)): k for k in range(256)}, 258, 9
        elif free >= 1 << width:
            width += 1
    if run:
        put(codes[run], width)
        free += 1
        if free >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(value << 8 - bits & 255)
    return bytes(out)


def _pack(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    raise ValueError(f"compression {compression} is not supported")


class Unsupported(ValueError):
    """A page that is sound but of a kind that is not decoded."""


class Damaged(ValueError):
    """A page or directory that cannot be read."""


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise Unsupported(f"compression {compression} is not supported")


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray
    bits: int = 8


def _directory(blob: bytes, order: str, at: int, big: bool) -> tuple[dict[int, list[int]], int]:
    count_form, offset, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
    head, room = struct.calcsize(f"{order}{count_form}"), struct.calcsize(f"{order}{offset}")
    (n,) = struct.unpack_from(f"{order}{count_form}", blob, at)
    tags: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HH{offset}", blob, at + head + entry * k)
        width = FIELD_BYTES.get(kind, 1)
        place = at + head + entry * k + 4 + room
        if width * count > room:
            (place,) = struct.unpack_from(f"{order}{offset}", blob, place)
        form = {1: "B", 3: "H", 4: "I", 16: "Q"}.get(kind)
        if form:
            if place + width * count > len(blob):
                raise ValueError("a field lies beyond the end")
            tags[tag] = list(struct.unpack_from(f"{order}{count}{form}", blob, place))
    (after,) = struct.unpack_from(f"{order}{offset}", blob, at + head + entry * n)
    return tags, after


def _block(blob: bytes, at: int, size: int, rows: int, cols: int, samples: int, compression: int, predictor: int, bits: int = 8, order: str = "<", mirrored: bool = False) -> np.ndarray:
    stride = (cols * samples * bits + 7) // 8
    data = blob[at : at + size]
    raw = _unpack(data.translate(_MIRRORED) if mirrored else data, compression, rows * stride)
    if len(raw) != rows * stride:
        raise ValueError("a strip or tile is too short")
    grid = np.frombuffer(raw, np.uint8)
    if bits < 8:
        grid = np.unpackbits(grid).reshape(rows, stride * 8 // bits, bits)[:, : cols * samples]
        grid = np.packbits(grid, axis=2) >> (8 - bits)
    elif bits == 16:
        grid = grid.view(f"{order}u2").astype("<u2")
    grid = grid.reshape(rows, cols, samples)
    return np.cumsum(grid, axis=1, dtype=grid.dtype) if predictor == 2 else grid


def _image(blob: bytes, order: str, tags: dict[int, list[int]], index: int) -> Page:
    one = lambda tag, default=None: (tags.get(tag) or [default])[0]
    width, height, samples, depths = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), set(tags.get(BITS) or [1])
    if not width or not height or not samples:
        raise ValueError("a page without a size")
    bits, compression, predictor, tiled = min(depths), one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in tags
    if len(depths) > 1 or bits not in (1, 4, 8, 16):
        raise Unsupported(f"samples of {sorted(depths)} bits are not supported")
    if bits == 16 and one(SAMPLE_FORMAT, 1) == 3:
        raise Unsupported("floating-point samples are not supported")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise Unsupported(f"predictor {predictor} is not supported with {bits} bits")
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise Unsupported(f"compression {compression} is not supported")
    planes = samples if one(PLANES, 1) == 2 else 1
    places, sizes = (tags.get(TILE_OFFSETS), tags.get(TILE_BYTES)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_BYTES))
    th, tw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    if not places or not sizes or not th or not tw:
        raise Damaged("strips or tiles have no place or no size")
    across = -(-width // tw)
    each = across * -(-height // th)
    if len(places) != len(sizes) or len(places) < each * planes:
        raise Damaged("strips or tiles are missing")
    # What a page may ask for in memory is bounded by the data that it has.
    held = min(sum(sizes[: each * planes]), len(blob))
    if height * ((width * samples * bits + 7) // 8) > held * GROWTH[compression] or (tiled and th * tw > 4 * held * GROWTH[compression]):
        raise Damaged("a page has more samples than its data can hold")
    image = np.zeros((height, width, samples), "<u2" if bits == 16 else np.uint8)
    for k in range(each * planes):
        plane, y, x = k // each, k % each // across * th, k % across * tw
        if places[k] + sizes[k] > len(blob):
            raise Damaged("a strip or tile lies beyond the end")
        rows = th if tiled else min(th, height - y)
        part = _block(blob, places[k], sizes[k], rows, tw, samples // planes, compression, predictor, bits, order, one(FILL_ORDER, 1) == 2)[: height - y, : width - x]
        image[y : y + th, x : x + tw, plane : plane + 1 if planes > 1 else samples] = part
    return Page(index, width, height, samples, compression, predictor, tiled, image, bits)


def _walk(blob: bytes | None) -> Iterator[Page | Unsupported | Damaged]:
    if not blob or len(blob) < 8 or blob[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return
    order, big = "<" if blob[:1] == b"I" else ">", b"+" in blob[2:4]
    seen, index = set(), 0
    try:
        (at,) = struct.unpack_from(f"{order}Q", blob, 8) if big else struct.unpack_from(f"{order}I", blob, 4)
    except struct.error as e:
        yield Damaged(str(e))
        return
    while at and at not in seen:
        seen.add(at)
        try:
            tags, at = _directory(blob, order, at, big)
        except (ValueError, struct.error, OverflowError) as e:
            yield Damaged(f"a directory cannot be read: {e}")
            return
        try:
            page = _image(blob, order, tags, index)
        except Unsupported as e:
            page = e
        except (ValueError, IndexError, ZeroDivisionError, OverflowError, MemoryError, struct.error, zlib.error) as e:
            page = e if isinstance(e, Damaged) else Damaged(f"{type(e).__name__}: {e}")
        yield page
        index += 1


def read_pages(blob: bytes | None) -> Iterator[Page]:
    """The pages of a TIFF file in the order of its directories; raises at one that cannot be read."""
    for page in _walk(blob):
        if isinstance(page, ValueError):
            raise page
        yield page


@dataclass(frozen=True)
class Form:
    """How a page is stored."""

    compression: int = DEFLATE
    predictor: int = 1
    rows_per_strip: int = 64
    tile: tuple[int, int] | None = None


def write_pages(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = PAGE_ROWS, tile: tuple[int, int] | None = None, order: str = "<", forms: list[Form] | None = None) -> bytes:
    """A TIFF file with one page for each array of 8-bit samples (rows, columns, samples); ``forms``: one for each page."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4)
    link = 4
    for k, image in enumerate(pages):
        if forms:
            compression, predictor, rows_per_strip, tile = forms[k].compression, forms[k].predictor, forms[k].rows_per_strip, forms[k].tile
        image = np.asarray(image, np.uint8).reshape(*image.shape[:2], -1)
        height, width, samples = image.shape
        if tile:
            th, tw = tile
            blocks = []
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    part = np.zeros((th, tw, samples), np.uint8)
                    cut = image[y : y + th, x : x + tw]
                    part[: cut.shape[0], : cut.shape[1]] = cut
                    blocks.append(part)
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        if predictor == 2:
            blocks = [np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])) for b in blocks]
        places, sizes = [], []
        for b in blocks:
            packed = _pack(b.tobytes(), compression)
            places.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        fields: dict[int, tuple[int, list[int]]] = {
            WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1 if samples < 3 else 2]), SAMPLES: (3, [samples]), PREDICTOR: (3, [predictor]),
        }
        if tile:
            fields |= {TILE_WIDTH: (4, [tile[1]]), TILE_HEIGHT: (4, [tile[0]]), TILE_OFFSETS: (4, places), TILE_BYTES: (4, sizes)}
        else:
            fields |= {STRIP_OFFSETS: (4, places), ROWS_PER_STRIP: (4, [rows_per_strip]), STRIP_BYTES: (4, sizes)}
        entries = bytearray()
        for tag, (kind, values) in sorted(fields.items()):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(f"{order}I", place)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def payload(text: bytes) -> bytes:
    """The text's bytes, padded to a positive multiple of UNIT."""
    return text + bytes((PAD,)) * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def form_of(page: bytes) -> Form:
    """How a page is stored, by its checksum, so equal pages are stored alike: one in sixteen with LZW, two with PackBits, the
    others deflated; every other one with the predictor, every fourth in tiles, the others in strips of 16 or 64 rows."""
    kind = zlib.crc32(page)
    compression = {0: LZW, 1: PACKBITS, 2: PACKBITS}.get(kind & 15, DEFLATE)
    return Form(compression, 1 + (kind >> 4 & 1), 16 << (kind >> 5 & 2), (16, 192) if kind >> 7 & 3 == 0 else None)


def store(data: bytes) -> bytes:
    """A payload as TIFF pages of UNIT columns and at most PAGE_ROWS rows, each in the form of ``form_of``."""
    grid = np.frombuffer(data, np.uint8).reshape(-1, UNIT)
    pages = [grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)]
    return write_pages(pages, forms=[form_of(p.tobytes()) for p in pages])


PAGE_FIELDS = [("page", pa.int32()), ("page_width", pa.int32()), ("page_height", pa.int32()), ("page_samples", pa.int32()), ("page_compression", pa.int32()), ("page_predictor", pa.int32()), ("page_tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string()), ("page_bits", pa.int32())]


def page_rows(blob: bytes | None) -> Iterator[tuple]:
    for index, p in enumerate(_walk(blob)):
        if isinstance(p, ValueError):
            yield (index, None, None, None, None, None, None, None, str(p), None)
        else:
            yield p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None, p.bits


def tiff_pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of the TIFF files in ``media_col``, with the input's other columns.

    Adds ``page, page_width, page_height, page_samples, page_compression, page_predictor, page_tiled, pixels, error, page_bits``;
    pixels are the samples by row. Narrow: no shuffle, one media value and its pages in memory at a time.
    """
    names = {n for n, _ in PAGE_FIELDS}
    keep = [c for c in media.columns if c != media_col and c not in names]
    kinds = {"int32": "int", "bool": "boolean", "binary": "binary", "string": "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields if f.name in keep] + [f"{n} {kinds[str(t)]}" for n, t in PAGE_FIELDS])

    def read(batches):
        for batch in batches:
            blobs, others = batch.column(batch.schema.get_field_index(media_col)), batch.select(keep)
            for k in range(batch.num_rows):
                rows = list(page_rows(blobs[k].as_py()))
                if rows:
                    left = others.take(pa.array([k] * len(rows), pa.int32()))
                    right = [pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), PAGE_FIELDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([*left.columns, *right], [*keep, *[n for n, _ in PAGE_FIELDS]])

    return media.select(*[f"`{c}`" for c in [*keep, media_col]]).mapInArrow(read, schema)


def features(pages: list[Page]) -> str:
    """Pages, rows, mean, deviation, share of rising neighbours and a histogram of eight bins, as text."""
    n = total = square = rising = pairs = rows = 0
    bins = np.zeros(8, np.int64)
    for p in pages:
        flat = p.pixels.reshape(-1)
        wide = flat.astype(np.int64)
        n, total, square, rows = n + flat.size, total + int(wide.sum()), square + int((wide * wide).sum()), rows + p.height
        rising, pairs = rising + int((flat[1:] > flat[:-1]).sum()), pairs + flat.size - 1
        bins += np.bincount(flat >> 5, minlength=8)
    mean = total / n
    return f"pages={len(pages)};rows={rows};mean={mean:.4f};sd={max(0.0, square / n - mean * mean) ** 0.5:.4f};rising={rising / max(1, pairs):.4f};hist=" + ",".join(map(str, bins))


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int"


def digest(text: bytes) -> tuple:
    """Stores one text as TIFF, reads the pages back and describes what was read."""
    blob = store(payload(text))
    pages = list(read_pages(blob))
    back = b"".join(p.pixels.tobytes() for p in pages)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), features(pages), len(pages)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the digest of its text's TIFF form. Null texts are empty; one text in memory at a time."""

    def run(batches):
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first in range(0, batch.num_rows, 512):
                rows = [digest((t.as_py() or "").encode()) for t in texts[first : first + 512]]
                cols = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids[first : first + 512], *cols], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {DIGEST}")


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a TIFF file and back."""
    return text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
