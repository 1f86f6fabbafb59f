"""TIFF columns: a lossless writer of 8-bit grey pages and a reader that emits one row per page.

The reader walks the chain of image directories in either byte order, decodes strips or tiles that are plain, PackBits,
LZW or deflate, undoes horizontal differencing (predictor 2) or the floating-point predictor (3), joins separate planes, and
crops edge tiles. Samples have 8, 16, 32 or 64 bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import spans

#: Tags, field types and compression schemes of the format; fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I"}
PAGE = ("page int", "width int", "height int", "samples int", "bits int", "compression int", "pixels binary", "error string", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "feature string")
#: Bytes of pixels after which a batch of pages goes on.
MOST = 8_000_000


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: bytes  # row by row, native bytes of each sample little-endian


def unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = 1
        while n < 128 and raw[i + n : i + n + 1] == raw[i : i + 1]:
            n += 1
        if n > 1:
            out += bytes((257 - n, raw[i]))
        else:
            while n < 128 and i + n < len(raw) and raw[i + n : i + n + 1] != raw[i + n + 1 : i + n + 2]:
                n += 1
            out.append(n - 1)
            out += raw[i : i + n]
        i += n
    return bytes(out)


def unlzw(raw: bytes) -> bytes:
    """Most significant bit first; code widths grow one code early; 256 clears and 257 ends."""
    out, table, width, held, have, last = [], [], 9, 0, 0, b""
    for byte in raw:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data without a leading clear code")
        if code < len(table):
            found = table[code]
        elif code == len(table) and last:
            found = last + last[:1]
        else:
            raise ValueError("LZW code beyond the table")
        out.append(found)
        if last:
            table.append(last + found[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = found
    return b"".join(out)


def lzw(raw: bytes) -> bytes:
    out, held, have, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, have
        held, have = held << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have)
            held &= (1 << have) - 1

    known: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    put(256)
    entry, free = b"", 258
    for i in range(len(raw)):
        longer = entry + raw[i : i + 1]
        if longer in known:
            entry = longer
            continue
        put(known[entry])
        known[longer] = free
        free += 1
        if free == 4095:
            put(256)
            known, free, width = {bytes((j,)): j for j in range(256)}, 258, 9
        elif free == 1 << width:
            width += 1
        entry = raw[i : i + 1]
    if entry:
        put(known[entry])
        free += 1
        if free == 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(held << 8 - have & 255)
    return bytes(out)


PACK = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw, DEFLATE: lambda raw: zlib.compress(raw, 1)}
UNPACK = {NONE: bytes, PACKBITS: unpack_bits, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}


def difference(block: np.ndarray, predictor: int, order: str) -> bytes:
    """Bytes of a (rows, width, samples) block as the predictor has them."""
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
    if predictor == 3:  # bytes of the row's samples by significance, then differences between bytes a pixel apart
        rows, width, samples = block.shape
        planes = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(rows, width * samples, -1).transpose(0, 2, 1).reshape(rows, -1, samples)
        return np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).tobytes()
    return block.astype(block.dtype.newbyteorder(order)).tobytes()


def undifference(raw: bytes, rows: int, width: int, samples: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """The block of such bytes, with samples of ``kind`` (floats only for predictor 3)."""
    size = rows * width * samples
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8, size * kind.itemsize).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        return planes.reshape(rows, kind.itemsize, -1).transpose(0, 2, 1).copy().view(kind.newbyteorder(">")).reshape(rows, width, samples)
    block = np.frombuffer(raw, kind, size).reshape(rows, width, samples)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else block


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", planar: int = 1) -> bytes:
    """Pages of numbers of 8 to 64 bits, of shape (height, width) or (height, width, samples)."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for page in pages:
        page = np.atleast_3d(page)
        h, w, s = page.shape
        th, tw = tile or (min(rows, h), w)
        at, sizes = [], []
        for plane in [page[:, :, i : i + 1] for i in range(s)] if planar == 2 else [page]:
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = plane[y : y + th, x : x + tw]
                    if tile:
                        block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                    raw = PACK[compression](difference(block, predictor, order))
                    at.append(len(out))
                    sizes.append(len(raw))
                    out += raw + b"\0" * (len(raw) % 2)
        bits, form = page.dtype.itemsize * 8, {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        tags = {WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [bits] * s), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [2 if s == 3 else 1]), SAMPLES: ("H", [s]), PLANAR: ("H", [planar]), PREDICTOR: ("H", [predictor]), SAMPLE_FORMAT: ("H", [form] * s)}
        tags |= {TILE_WIDTH: ("I", [tw]), TILE_HEIGHT: ("I", [th]), TILES: ("I", at), TILE_BYTES: ("I", sizes)} if tile else {STRIPS: ("I", at), ROWS: ("I", [th]), STRIP_BYTES: ("I", sizes)}
        fields = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(raw) > 4:
                place, raw = struct.pack(order + "I", len(out)), raw
                out += raw + b"\0" * (len(raw) % 2)
                raw = place
            fields.append(struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[kind], len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def read_tiff(raw: bytes) -> Iterator[Page]:
    """The pages in the order of the directory chain; ValueError for what is not such a file."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(raw):
            raise ValueError("broken chain of directories")
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, i)
            if kind in TYPES:
                form = f"{order}{count}{TYPES[kind]}"
                tags[tag] = struct.unpack_from(form, raw, i + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", raw, i + 8)[0])
        yield _page(raw, tags, order)
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def _page(raw: bytes, tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, s, bits, scheme, predictor, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    letter = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    known = bits in (8, 16, 32, 64) and letter and (letter != "f" or bits > 8) and (predictor in (1, 2) or (predictor == 3 and letter == "f"))
    if not w or not h or not known or scheme not in UNPACK or planar not in (1, 2) or len(set(tags.get(BITS, (1,)))) > 1:
        raise ValueError("a kind of page that this reader does not know")
    tiled = TILES in tags
    tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS, h), h))
    at, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    kind, across = np.dtype(f"{order}{letter}{bits // 8}"), -(-w // tw)
    each, deep = across * -(-h // th), 1 if planar == 2 else s
    pixels = np.empty((h, w, s), kind.newbyteorder("<"))
    for i, (a, size) in enumerate(zip(at, sizes, strict=True)):
        plane, n = divmod(i, each)
        y, x = n // across * th, n % across * tw
        rows = th if tiled else min(th, h - y)
        block = undifference(UNPACK[scheme](raw[a : a + size]), rows, tw, deep, kind, predictor)
        pixels[y : y + rows, x : x + tw, plane * deep : (plane + 1) * deep] = block[: h - y, : w - x]
    if len(at) != each * (s // deep):
        raise ValueError("strips or tiles are missing")
    return Page(w, h, s, bits, scheme, pixels.tobytes())


def digest(page: Page) -> tuple[int, str, int, str]:
    """Size, SHA-256 and CRC-32 of the last 64 bytes of a page's pixels, and its size, mean, deviation and distinct bytes."""
    count, n, values = np.bincount(np.frombuffer(page.pixels, np.uint8), minlength=256), len(page.pixels), np.arange(256)
    mean = (count @ values) / max(1, n)
    feature = f"{page.width}x{page.height} mean={mean:.6f} sd={np.sqrt(count @ (values - mean) ** 2 / max(1, n)):.6f} distinct={np.count_nonzero(count)}"
    return n, hashlib.sha256(page.pixels).hexdigest(), zlib.crc32(page.pixels[-64:]), feature


def tiff_pages(df: DataFrame, id_col: str, media_col: str, digests: bool = False) -> DataFrame:
    """One row per page: ``id_col``, page, width, height, samples, bits, compression, pixels, error.

    With ``digests`` the pixels stay in the worker: payload_bytes, payload_sha256, tail_crc32 and feature follow, and pixels is
    null. Other columns are ignored, whatever their names. Files are read one after the other and results go on after a
    few MB, so that memory is bounded by the largest file.

    Null media give no rows. Where a file or a page cannot be read, one row says so in ``error`` (null elsewhere) with the
    number of the page that failed and null fields; earlier pages of the file keep their rows. Files whose chain is empty
    give no rows. Repeated rows give repeated pages; an empty table gives an empty result. A lack of memory says nothing about
    a file and fails the task.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(n.split()[0] for n in PAGE)]
        types = [pa.int32()] * 6 + [pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, *types], strict=True)], names=names)

        for batch in spans(batches, "media"):
            out: list[tuple] = []
            held = 0
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not raw.is_valid:
                    continue
                n = 0
                try:
                    for page in read_tiff(raw.as_py()):
                        own = (None, None, *digest(page)) if digests else (page.pixels, None, None, None, None, None)
                        out.append((i, n, page.width, page.height, page.samples, page.bits, page.compression, *own))
                        held += 0 if digests else len(page.pixels)
                        n += 1
                        if held > MOST:
                            yield made(out, batch.schema.field(0).type)
                            out, held = [], 0
                except (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError, OverflowError) as e:
                    out.append((i, n, *[None] * 6, f"{type(e).__name__}: {e}", *[None] * 4))
            if out:
                yield made(out, batch.schema.field(0).type)

    pages = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, {', '.join(PAGE)}")
    return pages.select(F.col("id").alias(id_col), *(n.split()[0] for n in (PAGE if digests else PAGE[:8])))


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """``id_col``, n_bytes, media: every text as UTF-8, padded by zero bytes to a positive multiple of ``width``, as a page.

    A null text is stored as an empty one. Equal texts have equal media. Other columns are ignored, whatever their names.
    Texts are stored in groups of a few MB; a longer one is a group of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans(batches, "text"):
            size, media = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                size.append(len(raw))
                padded = raw.ljust(max(width, -(-len(raw) // width) * width), b"\0")
                media.append(write_tiff([np.frombuffer(padded, np.uint8).reshape(-1, width)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is read back from each text's stored page: one row per document with sizes, digests and a feature string.

    The feature is the page's size, mean and standard deviation of the samples and how many distinct ones there are. Edge
    cases are those of ``store_text`` and ``tiff_pages``, but a page that cannot be read back fails the task.
    """
    stored = store_text(docs, id_col, text_col).select(F.struct(F.col(id_col).alias("id"), "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("own"), "media")
    failed = F.raise_error(F.concat(F.lit("a stored page cannot be read back: "), F.col("error"))).cast("boolean")
    pages = tiff_pages(stored, "own", "media", digests=True).where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(failed))
    return pages.select(F.col("own.id").alias(id_col), "own.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "own.media_bytes", "own.media_sha256", "feature")
