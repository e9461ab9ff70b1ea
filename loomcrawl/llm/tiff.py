"""TIFF pages: walk the image directories, decode strips and tiles, undo predictors, one row per page.

Reads classic TIFF (either byte order), compression none (1), LZW (5), deflate (8, 32946) and PackBits (32773),
predictors none (1) and horizontal differencing (2), strips and tiles, 8- and 16-bit samples, chunky layout.
The writer makes all of these.

Sizes are checked before memory is asked for: a directory that claims more samples than its bytes can hold in its
compression, or pages of more than PAGE_BYTES, is an error, and nothing is unpacked beyond the size of its strip or tile.

Defined results: null or empty media has no page; a broken file gives its sound pages and one row with `error` set and
no samples; directories that point back at a visited one end the walk; extra columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomcrawl.llm.common import map_batches, table, texts_of

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
#: Bytes that one stored byte can stand for at most: a run of 128 in two bytes; 1,032 in deflate; a word of 4,096 in nine bits.
_GROWTH = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, 32946: 1032, LZW: 3641}
#: The largest page that is read; larger ones are errors.
PAGE_BYTES = 1 << 30


class TiffError(ValueError):
    """The bytes are no TIFF that this reader knows."""


_RUN = re.compile(rb"(.)\1{1,127}", re.S)


def packbits(data: bytes) -> bytes:
    """PackBits form of data: runs of two or more equal bytes, literals of up to 128."""
    out, at = bytearray(), 0
    for m in itertools.chain(_RUN.finditer(data), (None,)):
        for i in range(at, m.start() if m else len(data), 128):
            literal = data[i : min(i + 128, m.start() if m else len(data))]
            out.append(len(literal) - 1)
            out += literal
        if m:
            at = m.end()
            out += bytes((257 - (at - m.start()), data[m.start()]))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        else:
            if c > 128:
                out += data[i + 1 : i + 2] * (257 - c)
            i += 1 + (c > 128)
    return bytes(out)


#: Bits of the codes behind a clear code, in order: the width grows one code early, and the table is full at 4,096.
_WIDTHS = np.array([min(12, (258 + i).bit_length()) for i in range(3839)])
_CLEAR, _END = 256, 257


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes of 9 to 12 bits."""
    codes, widths, own, known, word = [np.array([_CLEAR])], [_WIDTHS[:1]], [], {}, -1

    def told() -> None:
        codes.append(np.array(own))
        widths.append(_WIDTHS[: len(own)])
        own.clear()
        known.clear()

    for c in data:
        if word < 0:
            word = c
            continue
        longer = known.get(word << 8 | c)
        if longer is not None:
            word = longer
            continue
        own.append(word)
        known[word << 8 | c] = len(own) + 257
        if len(own) == 3836:
            own.append(_CLEAR)
            told()
        word = c
    own += [word, _END] if word >= 0 else [_END]
    told()
    code, width = np.concatenate(codes), np.concatenate(widths)
    end = np.cumsum(width)
    bits = np.zeros(int(end[-1]), np.uint8)
    for k in range(12):
        has = width > k
        bits[end[has] - 1 - k] = code[has] >> k & 1
    return np.packbits(bits).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    """The first `size` bytes or few more."""
    raw, total = np.frombuffer(data + b"\0\0\0", np.uint8), 8 * len(data)
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, last, out, made, at, since = list(first), b"", [], 0, 0, 0
    while made < size:
        # All codes up to the next change of width, unless a clear code comes first.
        width = int(_WIDTHS[min(since, len(_WIDTHS) - 1)])
        n = min(int(np.searchsorted(_WIDTHS, width, "right")) - since if width < 12 else 4096, (total - at) // width)
        if n <= 0:
            break
        place = at + width * np.arange(n)
        byte = place >> 3
        value = raw[byte].astype(np.int64) << 16 | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2]
        for code in (value >> (24 - width - (place & 7)) & (1 << width) - 1).tolist():
            at += width
            since += 1
            if code == _END:
                return b"".join(out)
            if code == _CLEAR:
                words, last, since = list(first), b"", 0
                break
            if code < len(words):
                word = words[code]
            elif last and code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            out.append(word)
            made += len(word)
            if last:
                if len(words) == 4096:
                    raise TiffError("LZW table overflows")
                words.append(last + word[:1])
            last = word
            if made >= size:
                break
    return b"".join(out)


_PACK = {NONE: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 6), PACKBITS: packbits}


def _unpack(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data
    if kind == LZW:
        return unlzw(data, size)
    if kind in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(data, size) if size else b""
    if kind == PACKBITS:
        return unpackbits(data, size)
    raise TiffError(f"compression {kind}")


def _parts(page: np.ndarray, strip_bytes: int, tile: tuple[int, int] | None) -> tuple[int, Iterator[np.ndarray]]:
    """Rows of a strip, and the strips; or the tiles, filled up with zeros at the edges."""
    rows, cols = page.shape[:2]
    if tile is None:
        per = max(1, strip_bytes // max(1, page[:1].nbytes))
        return per, (page[at : at + per] for at in range(0, rows, per))
    width, height = tile
    whole = np.zeros((-(-rows // height) * height, -(-cols // width) * width, page.shape[2]), page.dtype)
    whole[:rows, :cols] = page
    return 0, (whole[t : t + height, x : x + width] for t in range(0, rows, height) for x in range(0, cols, width))


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_bytes: int = 65536, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of pages (rows x columns, or rows x columns x channels; 8- or 16-bit), in strips of about strip_bytes or in tiles (width, height)."""
    out, links = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0)), 4
    for page in pages:
        page = page.reshape(*page.shape[:2], -1)
        rows, cols, deep = page.shape
        bits = 8 * page.itemsize
        per, parts = _parts(page, strip_bytes, tile)
        packed = []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(page.dtype)
            packed.append(_PACK[compression](part.astype(part.dtype.newbyteorder(order)).tobytes()))
        offsets = []
        for p in packed:
            offsets.append(len(out))
            out += p + b"\0" * (len(p) & 1)

        def values(kind: str, numbers: list[int]) -> bytes:
            """What an entry holds: its numbers, or where they stand."""
            raw = struct.pack(f"{order}{len(numbers)}{kind}", *numbers)
            if len(raw) > 4:
                out.extend(raw + b"\0" * (len(raw) & 1))
                raw = struct.pack(f"{order}I", len(out) - len(raw) - (len(raw) & 1))
            return raw.ljust(4, b"\0")

        sizes = [len(p) for p in packed]
        layout = [(273, "I", offsets), (278, "I", [per]), (279, "I", sizes)] if tile is None else [(322, "I", [tile[0]]), (323, "I", [tile[1]]), (324, "I", offsets), (325, "I", sizes)]
        tags = [(256, "I", [cols]), (257, "I", [rows]), (258, "H", [bits] * deep), (259, "H", [compression]), (262, "H", [2 if deep == 3 else 1]), (277, "H", [deep]), (317, "H", [predictor]), *layout]
        entries = [struct.pack(f"{order}HHI", tag, 3 if kind == "H" else 4, len(numbers)) + values(kind, numbers) for tag, kind, numbers in sorted(tags)]
        struct.pack_into(f"{order}I", out, links, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        links = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    tags: dict[int, list[int]] = {}
    for i in range(n):
        place = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, place)
        if kind not in _CODES or tag in tags:
            continue
        where = place + 8 if _SIZES[kind] * count <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
        if where + _SIZES[kind] * count > len(data):
            raise TiffError("a tag's values lie outside the file")
        tags[tag] = list(struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, where))
    return tags, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _samples(data: bytes, tags: dict[int, list[int]], order: str) -> np.ndarray:
    cols, rows = tags[256][0], tags[257][0]
    deep, bits = tags.get(277, [1])[0], tags.get(258, [8])[0]
    if bits not in (8, 16) or tags.get(284, [1])[0] != 1 and deep > 1:
        raise TiffError("only 8- or 16-bit samples in chunky layout")
    kind, predictor = tags.get(259, [1])[0], tags.get(317, [1])[0]
    width, height = (tags[322][0], tags[323][0]) if 322 in tags else (cols, min(rows, tags.get(278, [rows])[0]))
    offsets, lengths = (tags[324], tags[325]) if 322 in tags else (tags[273], tags[279])
    if min(rows, cols, deep, width, height) < 1:
        raise TiffError("a size is zero or less")
    across, dtype = -(-cols // width), np.dtype(np.uint8 if bits == 8 else f"{order}u2")
    if len(offsets) != len(lengths) or len(offsets) != across * -(-rows // height):
        raise TiffError("the strips or tiles don't make up the page")
    if kind not in _GROWTH:
        raise TiffError(f"compression {kind}")
    stored = sum(min(n, len(data)) for n in lengths)
    if max(rows * cols, len(offsets) * width * height * (322 in tags)) * deep * bits // 8 > min(PAGE_BYTES, stored * _GROWTH[kind]):
        raise TiffError("the page is larger than its bytes can hold, or than is read")
    whole = np.zeros((rows, cols, deep), dtype)
    for k, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        top, left = k // across * height, k % across * width
        high = height if 322 in tags else min(height, rows - top)
        raw = _unpack(kind, data[o : o + n], high * width * deep * bits // 8)
        if len(raw) < high * width * deep * bits // 8:
            raise TiffError("a strip or tile is too short")
        part = np.frombuffer(raw, dtype, high * width * deep).reshape(high, width, deep)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=dtype.newbyteorder("=")).astype(dtype)
        elif predictor != 1:
            raise TiffError(f"predictor {predictor}")
        whole[top : top + high, left : left + width] = part[: rows - top, : cols - left]
    return whole


def decode(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(page, compression, bits, samples rows x columns x channels) of each directory in turn."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:1] == b"I" else ">"
    try:
        (at,), page, seen = struct.unpack_from(f"{order}I", data, 4), 0, set()
        while at and at not in seen:
            seen.add(at)
            tags, following = _directory(data, order, at)
            yield page, tags.get(259, [1])[0], tags.get(258, [8])[0], _samples(data, tags, order)
            at, page = following, page + 1
    except (struct.error, KeyError, IndexError, ValueError, OverflowError, MemoryError, ZeroDivisionError, zlib.error) as e:
        raise e if isinstance(e, TiffError) else TiffError(f"broken file: {e}") from e


def explode_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of each media value: id, page, width, height, channels, bits, compression, samples, error."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, page int, width int, height int, channels int, bits int, compression int, samples binary, error string"
    names = ["page", "width", "height", "channels", "bits", "compression", "samples", "error"]
    kinds = [*[pa.int32()] * 6, pa.binary(), pa.string()]

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            at, rows = [], []
            for i, media in enumerate(b.column(1).to_pylist()):
                if not media:
                    continue
                try:
                    for page, kind, bits, x in decode(media):
                        rows.append((page, x.shape[1], x.shape[0], x.shape[2], bits, kind, x.tobytes(), None))
                        at.append(i)
                except TiffError as e:
                    rows.append((*[None] * 7, str(e)))
                    at.append(i)
            ids = b.column(0).take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], kinds[k]) for k in range(8))], names=[id_col, *names])

        return step

    return map_batches(df.select(id_col, media_col), schema, make)


def feature(x: np.ndarray) -> str:
    """64 bits in hex, 8 x 8: is the mean of a cell over the mean of the next cell to the right (around the row)?

    Rows are cut to eight bands of nearly equal height; a page of fewer rows repeats them.
    """
    grey = x.reshape(x.shape[0], -1)
    cells = grey.reshape(len(grey), 8, -1).sum(axis=2, dtype=np.int64)
    edges = np.arange(9) * len(grey) // 8
    total = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(cells, axis=0)])
    last = np.maximum(edges[1:], np.minimum(edges[:-1] + 1, len(grey)))
    bands = (total[last] - total[edges[:-1]]) / (last - edges[:-1])[:, None]
    return np.packbits(bands > np.roll(bands, -1, axis=1)).tobytes().hex()


def payload(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


#: Rows of a page of op2, and the forms its payloads take in turn, by their crc32: compression, predictor, tile.
PAGE_ROWS = 1024
FORMS = ((DEFLATE, 2, None), (LZW, 1, None), (PACKBITS, 2, (32, 32)), (DEFLATE, 1, (48, 16)))


def media_of(raw: bytes) -> bytes:
    """A payload as a TIFF of grey pages 64 samples wide; equal payloads have equal bytes."""
    compression, predictor, tile = FORMS[zlib.crc32(raw) % len(FORMS)]
    x = np.frombuffer(raw, np.uint8).reshape(-1, 64)
    return encode([x[at : at + PAGE_ROWS] for at in range(0, len(x), PAGE_ROWS)], compression, predictor, 16384, tile)


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a TIFF of grey pages, decoded again page by page; the digests are of what was read back."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for t in texts_of(b.column(1)):
                n, raw = payload(t)
                media = media_of(raw)
                x = np.concatenate([samples for _, _, _, samples in decode(media)])
                back = x.tobytes()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(x), -(-len(x) // PAGE_ROWS)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"]
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(8))], names=["doc_id", *names])

        return step

    return map_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long", make)


QUERIES = {"op2_tiff_pages": op2_tiff_pages}
SQL: dict[str, str] = {}
