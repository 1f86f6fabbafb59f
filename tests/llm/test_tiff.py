import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidecast.llm import tiff as T


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("scheme", [T.NONE, T.PACKBITS, T.LZW, T.DEFLATE])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_roundtrip(order, predictor, scheme, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (37, 50), np.uint8), np.zeros((5, 3, 3), np.uint8), rng.integers(0, 60000, (9, 70), np.uint16), rng.integers(0, 256, (200, 64), np.uint8)]
    got = list(T.read_tiff(T.write_tiff(pages, scheme, predictor, 8, tile, order)))
    assert [(p.height, p.width) for p in got] == [p.shape[:2] for p in pages]
    for p, q in zip(pages, got, strict=True):
        assert p.astype(p.dtype.newbyteorder("<")).tobytes() == q.pixels


@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("kind, predictor", [("u1", 2), ("u2", 2), ("u4", 2), ("u8", 1), ("i2", 2), ("f4", 1), ("f4", 3), ("f8", 3), ("f2", 3)])
def test_kinds_and_planes(kind, predictor, tile, planar):
    rng = np.random.default_rng(3)
    for order in "<>":
        page = (rng.normal(size=(37, 50, 3)) * 100).astype(kind)
        (got,) = T.read_tiff(T.write_tiff([page], T.DEFLATE, predictor, 8, tile, order, planar))
        assert got.samples == 3 and got.pixels == page.astype(page.dtype.newbyteorder("<")).tobytes()


def test_lzw_long():
    rng = np.random.default_rng(2)
    for raw in (b"", b"a", b"ab" * 9000, rng.integers(0, 256, 60000, np.uint8).tobytes(), rng.integers(0, 3, 200000, np.uint8).tobytes()):
        assert T.unlzw(T.lzw(raw)) == raw
        assert T.unpack_bits(T.pack_bits(raw)) == raw


def test_rows(spark):
    texts = [(1, "abc"), (2, ""), (3, None), (4, "é" * 5000), (4, "é" * 5000), (None, "x" * 64)]
    rows = T.media_features(spark.createDataFrame([(*t, 7) for t in texts], "doc_id long, text string, media int")).collect()
    assert len(rows) == len(texts)
    want = {}
    for i, t in texts:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
        want[i] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    for r in rows:
        raw = (dict(texts)[r.doc_id] or "").encode()
        pixels = np.frombuffer(raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64, np.uint8)
        media = T.write_tiff([pixels.reshape(-1, 64)])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == f"64x{len(pixels) // 64} mean={pixels.mean():.6f} sd={pixels.std():.6f} distinct={len(set(pixels.tolist()))}"
    assert T.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_broken(spark):
    good = T.write_tiff([np.zeros((4, 4), np.uint8), np.ones((4, 4), np.uint8)])
    rows = T.tiff_pages(spark.createDataFrame([(1, good), (2, b"II*"), (3, None), (4, good[:-60])], "k long, m binary"), "k", "m").collect()
    assert sorted((r.k, r.page, r.error is None) for r in rows if r.k < 4) == [(1, 0, True), (1, 1, True), (2, 0, False)]
    assert any(r.k == 4 and r.error for r in rows)


def test_media_that_cannot_be_read_back_fails(spark, monkeypatch):
    docs, store = spark.createDataFrame([(1, "a"), (2, "b" * 500)], "doc_id long, text string"), T.store_text
    monkeypatch.setattr(T, "store_text", lambda *a: store(*a).withColumn("media", F.when(F.col("doc_id") == 2, F.expr("substr(media, 1, 20)")).otherwise(F.col("media"))))
    with pytest.raises(Exception, match="cannot be read back"):
        T.media_features(docs).collect()


def test_lack_of_memory_is_not_an_error_row(spark, monkeypatch):
    def short(raw):
        raise MemoryError

    files, made = spark.createDataFrame([(1, b"II*")], "k long, m binary"), []
    monkeypatch.setattr(T, "read_tiff", short)
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, kind: made.append(run) or spark.createDataFrame([], kind))
    T.tiff_pages(files, "k", "m")
    with pytest.raises(MemoryError):
        list(made[0]([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"II*"])], names=["id", "media"])]))


def test_packed_bytes_of_the_format():
    """Byte strings that were not made by this module: the run-length example of the format's technical note, and the codes of
    the LZW example in the format's specification."""
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")
    assert T.unpack_bits(packed) == plain and T.unpack_bits(b"\x80" + packed) == plain
    bits = "".join(f"{code:09b}" for code in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert T.unlzw(raw) == bytes((7, 7, 7, 8, 8, 7, 7, 6, 6)) and T.lzw(bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))) == raw


@pytest.mark.parametrize("order", ["<", ">"])
def test_a_file_laid_out_by_hand(order):
    """Two directories, the second one first in the file; strips of two rows, the last one short, packed by run lengths."""
    fields = lambda *rows: struct.pack(order + "H", len(rows)) + b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v)) for t, k, v in rows)
    strips = b"\xfd\x05" + b"\x01\x07\x08"  # 5 5 5 5, then 7 8
    second = 8 + len(strips) + 1
    one = fields((256, 3, 2), (257, 3, 1), (258, 3, 8), (259, 3, 32773), (262, 3, 1), (273, 4, 10), (277, 3, 1), (278, 3, 1), (279, 4, 3)) + struct.pack(order + "I", 0)
    first = second + len(one)
    two = fields((256, 3, 2), (257, 3, 2), (258, 3, 8), (259, 3, 32773), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, 2)) + struct.pack(order + "I", second)
    raw = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, first) + strips + b"\0" + one + two
    got = list(T.read_tiff(raw))
    assert [(p.width, p.height, p.pixels) for p in got] == [(2, 2, b"\5\5\5\5"), (2, 1, b"\7\x08")]


def test_long_text_and_many_pages(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST", 100)
    docs = spark.createDataFrame([(1, "ab" * 2_000_000), (2, "c"), (None, "d" * 200)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.payload_bytes) for r in T.media_features(docs).collect()) == [(1, 64), (200, 256), (4_000_000, 4_000_000)]
    files = spark.createDataFrame([(1, T.write_tiff([np.full((9, 9), i, np.uint8) for i in range(20)]), "x")], "k long, m binary, page string")
    assert [(r.page, r.pixels[0]) for r in T.tiff_pages(files, "k", "m").orderBy("page").collect()] == [(i, i) for i in range(20)]
