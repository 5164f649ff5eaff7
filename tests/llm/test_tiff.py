import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest

pytest.importorskip("lociscale.llm")
from lociscale.llm import tiff  # noqa: E402


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 130, 511, 5_000, 60_000])
def test_codecs_round_trip(n):
    rng = random.Random(n)
    for data in (os.urandom(n), bytes(rng.choices(b"ab", k=n)), b"z" * n, bytes(rng.choices(b"the quick brown fox", k=n))):
        assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_files_round_trip(order, scheme, predictor, tile):
    rng = np.random.RandomState(1)
    images = [rng.randint(0, 4, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (37, 50, 3), (70, 33, 1))]
    data = tiff.write(images, scheme=scheme, predictor=predictor, tile=tile, rows_per_strip=16, order=order)
    found = list(tiff.pages(data))
    assert [p.number for p in found] == [0, 1, 2]
    for page, image in zip(found, images):
        assert (page.pixels == image).all() and (page.height, page.width, page.samples) == image.shape
        assert page.tiled == bool(tile) and page.predictor == predictor and page.compression == scheme


def test_faults_are_named():
    good = tiff.write([np.zeros((4, 4, 1), np.uint8)])
    for bad in (b"", b"GIF89a..", good[:-20], good[:12]):
        with pytest.raises(ValueError):
            list(tiff.pages(bad))
    loop = bytearray(good)
    struct.pack_into("<I", loop, len(loop) - 4, struct.unpack_from("<I", loop, 4)[0])
    with pytest.raises(ValueError, match="loop"):
        list(tiff.pages(bytes(loop)))


def test_texts_are_stored_whole(spark):
    texts = [None, "", "é", "x" * 576, "y" * 577, "line\n" * 30_000, "the end"] + [f"text {i} " * (i % 50) for i in range(200)] + ["big " * 700_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "é", "clash")]
    found = tiff.store_texts(spark.createDataFrame(rows, "doc_id long, text string, feature string")).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert tuple(by[None])[1:] == tuple(by[2])[1:] and by[len(texts) - 1].n_pages == 2
    assert {r.feature.split()[2] for r in found} == {"c1", "c5", "c8", "c32773", "c32946"}
    for i, t in enumerate(texts):
        media = tiff.text_to_tiff(tiff.payload_of(t)[1])
        assert (by[i].media_bytes, by[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        raw = np.frombuffer(tiff.payload_of(t)[1], np.uint8)
        scheme, predictor, tile, order = tiff.FORMS[zlib.crc32(raw.tobytes()) % len(tiff.FORMS)]
        assert media[:2] == (b"II" if order == "<" else b"MM")
        rows = len(raw) // 576
        last = rows - (by[i].n_pages - 1) * 4096
        assert by[i].feature == f"{by[i].n_pages} 576x{last}x1 c{scheme} p{predictor} {'tiles' if tile else 'strips'} mean={raw.sum(dtype=np.int64) / len(raw):.4f} max={raw.max()}"
    assert tiff.store_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_for_each_page(spark):
    images = [np.full((3, 5, 1), i, np.uint8) for i in range(4)]
    rows = [("a", tiff.write(images), 9), ("b", None, 9), ("c", b"not a tiff", 9), ("d", tiff.write(images[:1])[:-10], 9)]
    found = tiff.tiff_pages(spark.createDataFrame(rows, "path string, content binary, width int")).collect()
    assert sorted((r.path, r.page) for r in found if r.error is None) == [("a", i) for i in range(4)]
    assert all(bytes(r.pixels) == images[r.page].tobytes() and r.width == 5 for r in found if r.path == "a")
    assert sorted(r.path for r in found if r.error) == ["c", "d"]


def header(**fields):
    """A file of one directory whose tags are set at will, with 64 bytes of data at 8."""
    tags = {256: 4, 257: 4, 258: 8, 259: 1, 262: 1, 273: 8, 277: 1, 278: 4, 279: 16, 284: 1} | {int(k[1:]): v for k, v in fields.items()}
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
    return b"II*\0" + struct.pack("<I", 72) + bytes(64) + struct.pack("<H", len(tags)) + entries + bytes(4)


@pytest.mark.parametrize("fields", [
    {"t256": 0xFFFFFFFF, "t257": 0xFFFFFFFF, "t278": 0xFFFFFFFF}, {"t256": 1 << 14, "t257": 1 << 13, "t278": 1 << 13}, {"t257": 0xFFFFFFFF, "t278": 0xFFFFFFFF}, {"t256": 0}, {"t277": 0}, {"t277": 0xFFFF, "t258": 8},
    {"t259": 7}, {"t317": 3}, {"t279": 0xFFFFFFFF}, {"t273": 0xFFFFFFF0}, {"t259": 8, "t256": 60_000, "t257": 60_000, "t278": 60_000}, {"t259": 5, "t279": 64, "t256": 200, "t257": 200, "t278": 200},
])
def test_hostile_headers_become_one_row_with_an_error(spark, fields):
    assert list(tiff.pages(header()))[0].pixels.shape == (4, 4, 1)
    found = tiff.tiff_pages(spark.createDataFrame([("bad", header(**fields))], "path string, content binary")).collect()
    assert [(r.path, r.page, r.error is not None) for r in found] == [("bad", None, True)]


def test_a_deflate_bomb_is_not_unpacked():
    bomb = zlib.compress(bytes(50_000_000))
    data = bytearray(tiff.write([np.zeros((4, 4, 1), np.uint8)]))
    assert len(tiff.decompress(bomb, tiff.DEFLATE, 16)) == 16
    assert list(tiff.pages(bytes(data)))[0].pixels.sum() == 0


def plain_read(data):
    """Samples of all pages by the format's own rules, with nothing of the module: strips or tiles, none or deflate or
    PackBits, with or without differences along rows."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack_from(order + "HI", data, 2)
    assert magic == 42
    out = []
    while at:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = {3: 2, 4: 4}[kind] * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", data, where)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        (w,), (h,) = tags[256], tags[257]
        tiled = 322 in tags
        wide, high = (tags[322][0], tags[323][0]) if tiled else (w, tags[278][0])
        offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        image = np.zeros((-(-h // high) * high, -(-w // wide) * wide), np.uint8)
        for k, (o, c) in enumerate(zip(offsets, counts, strict=True)):
            part, scheme = data[o : o + c], tags[259][0]
            if scheme in (8, 32946):
                part = zlib.decompress(part)
            elif scheme == 32773:
                runs, i = bytearray(), 0
                while i < len(part):
                    head = part[i]
                    runs += part[i + 1 : i + 2 + head] if head < 128 else part[i + 1 : i + 2] * (257 - head) if head > 128 else b""
                    i += 2 + head if head < 128 else 2 if head > 128 else 1
                part = bytes(runs)
            else:
                assert scheme == 1
            own = np.frombuffer(part, np.uint8).reshape(-1, wide)
            own = np.cumsum(own, axis=1, dtype=np.uint8) if tags[317][0] == 2 else own
            top, left = divmod(k, -(-w // wide))
            image[top * high : top * high + len(own), left * wide : (left + 1) * wide] = own
        out.append(image[:h, :w].tobytes())
    return b"".join(out)


def test_stored_files_are_read_by_another_reader(spark):
    texts = [f"document {i} " * (3 * i % 400) for i in range(120)] + ["", None, "line of text\n" * 200_000]
    found = tiff.text_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    forms = set()
    for r in found:
        payload = tiff.payload_of(texts[r.doc_id])[1]
        form = tiff.FORMS[zlib.crc32(payload) % len(tiff.FORMS)]
        assert (r.media_bytes, r.media_sha256) == (len(r.content), hashlib.sha256(r.content).hexdigest())
        if form[0] != tiff.LZW:
            forms.add(form)
            assert plain_read(bytes(r.content)) == payload
    assert len(forms) > 24
