"""op2's writer and reader over all layouts, broken files, and its query against plain recomputation."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from loomcrawl.llm import registry, tiff


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 16), (48, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_layouts(codec, tile, order, predictor):
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16):
        for deep in (1, 3, 4):
            pages = [rng.integers(0, top, (r, c, deep)).astype(kind) for r, c, top in ((1, 1, 9), (7, 64, 4), (70, 33, 3), (40, 50, 60000 if kind == np.uint16 else 256))]
            back = list(tiff.decode(tiff.encode(pages, codec, predictor, 900, tile, order)))
            assert [(p, c, b) for p, c, b, _ in back] == [(i, codec, 8 * pages[0].itemsize) for i in range(4)]
            assert all((a == x).all() for a, (_, _, _, x) in zip(pages, back, strict=True))


def test_long_lzw_and_packbits():
    rng = random.Random(2)
    for data in (bytes(100_000), bytes(rng.randrange(256) for _ in range(20_000)), b"ab" * 30_000, bytes(i // 200 % 256 for i in range(70_000))):
        assert tiff.unlzw(tiff.lzw(data), len(data)) == data and tiff.unpackbits(tiff.packbits(data), len(data)) == data


def _file(tags):
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
    return struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + entries + b"\0\0\0\0" + bytes(64)


GOOD = {256: 8, 257: 8, 258: 8, 259: 1, 273: 8, 277: 1, 278: 8, 279: 64}


@pytest.mark.parametrize(
    "change",
    [{256: 0}, {257: 0}, {278: 0}, {277: 0}, {277: 2**32 - 1}, {258: 7}, {259: 99}, {257: 2**31 - 1, 278: 2**31 - 1}, {257: 2**31 - 1, 256: 2**31 - 1}, {259: 8}, {259: 5}, {259: 32773, 257: 9000}, {279: 3}, {273: 10**6}, {317: 3}, {322: 0, 323: 16, 324: 8, 325: 64}, {322: 16, 323: 0, 324: 8, 325: 64}, {322: 2**31, 323: 2**31, 324: 8, 325: 64}, {322: 16, 323: 16}],
    ids=str,
)
def test_broken_directories(change):
    assert len(list(tiff.decode(_file(GOOD)))) == 1
    with pytest.raises(tiff.TiffError):
        list(tiff.decode(_file({**GOOD, **change})))


def test_bombs_and_noise(spark):
    bomb = zlib.compress(bytes(50_000_000))
    media = bytearray(tiff.encode([np.zeros((4, 4), np.uint8)]))
    at = media.index(zlib.compress(bytes(16), 6))
    bombed = bytes(media[:at]) + bomb + bytes(media[at:])
    for cut in range(0, len(media), 3):
        try:
            list(tiff.decode(bytes(media[:cut])))
        except tiff.TiffError:
            pass
    rng = random.Random(4)
    for _ in range(1500):
        noisy = bytearray(media)
        for _ in range(rng.randint(1, 6)):
            noisy[rng.randrange(4, len(noisy))] = rng.randrange(256)
        try:
            list(tiff.decode(bytes(noisy)))
        except tiff.TiffError:
            pass
    rows = tiff.explode_pages(spark.createDataFrame([(1, bombed), (2, _file({**GOOD, 256: 0})), (3, bytes(media)), (4, None), (None, bytes(media))], "i long, m binary"), "i", "m").collect()
    assert {r.i for r in rows if r.error} >= {2} and {r.i for r in rows if r.error is None} >= {3, None} and 4 not in {r.i for r in rows}


def test_query_against_plain(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", "a", "é" * 40, "x" * 64, "same", "same", *("".join(rng.choice("ab \n€") for _ in range(rng.randint(1, 3000))) for _ in range(30)), "long " * 40_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in registry.QUERIES["op2_tiff_pages"](spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        whole = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = tiff.media_of(whole)
        samples = np.concatenate([x for _, _, _, x in tiff.decode(media)])
        assert samples.tobytes() == whole
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r.media_bytes, r.media_sha256, r.n_pages) == (len(media), hashlib.sha256(media).hexdigest(), -(-len(whole) // 65536))
        # The feature, cell by cell.
        grid = np.frombuffer(whole, np.uint8).reshape(-1, 64)
        edges = [k * len(grid) // 8 for k in range(9)]
        mean = [[grid[edges[k] : max(edges[k + 1], min(edges[k] + 1, len(grid))), 8 * c : 8 * c + 8].mean() for c in range(8)] for k in range(8)]
        bits = "".join(str(int(m[c] > m[(c + 1) % 8] + 1e-9)) for m in mean for c in range(8))
        assert r.feature == f"{int(bits, 2):016x}"
    assert rows[5][1:] == rows[6][1:] and rows[40 - 4 + 1].n_pages > 1
