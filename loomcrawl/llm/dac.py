"""Token ids in directly addressable codes: any id is read without decoding a block.

An id is cut into chunks of `width` bits, low chunk first. Level l holds, in order, chunk l of every id that has one,
a bitmap that says which of them go on, and a rank directory: the set bits before each word of 64 bits, so that
rank is one lookup and one population count. Access follows rank from level to level.

A file (little-endian) is: magic, width, levels, number of documents, number of ids, first id's place in the corpus,
document ids, document bounds, then per level its length, chunks, bitmap words and directory.

Files are rows of a Parquet table in the shared folder, written by Spark's committer, at most FILE_IDS ids each (a
longer document gets a file of its own). Executors share no other folder, and a lost task leaves nothing behind.

Defined results: null or empty text is the end id alone; documents are ordered by (doc_id, text), null first, so
repeated doc_ids have a definite order; an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.llm import bytebpe
from loomcrawl.llm.common import kept, slices, stored, table

MAGIC, END, FILE_IDS = b"DAC1", 2, 1 << 20
#: Distinct chunks a worker remembers, at most twice as many: some 200 bytes each.
CHUNKS = 800_000
_HEAD = "<4sBBxxqqq"


def pack(ids: np.ndarray, docs: np.ndarray, bounds: np.ndarray, start: int, width: int = 8) -> bytes:
    """The file of ids (uint32); bounds has one entry more than docs and begins at 0."""
    dtype = np.uint8 if width == 8 else np.uint16
    rest, parts = ids.astype(np.uint32), []
    while True:
        chunk, rest = (rest & ((1 << width) - 1)).astype(dtype), rest >> np.uint32(width)
        more = rest > 0
        words = np.zeros(-(-len(more) // 64) or 1, np.uint64)
        bits = np.packbits(more, bitorder="little")
        words.view(np.uint8)[: len(bits)] = bits
        ranks = np.zeros(len(words), np.uint32)
        ranks[1:] = np.cumsum(np.bitwise_count(words[:-1]), dtype=np.uint32)
        last = not more.any()
        parts.append(struct.pack("<q", len(chunk)) + chunk.tobytes() + (b"" if last else words.tobytes() + ranks.tobytes()))
        if last:
            break
        rest = rest[more]
    return struct.pack(_HEAD, MAGIC, width, len(parts), len(docs), len(ids), start) + docs.astype("<i8").tobytes() + bounds.astype("<i8").tobytes() + b"".join(parts)


class Reader:
    """One file: access(i) reads an id, slice(i, j) a range, ids() all of them."""

    def __init__(self, data: bytes):
        magic, self.width, levels, n_docs, self.n, self.start = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = struct.calcsize(_HEAD)
        self.docs = np.frombuffer(data, "<i8", n_docs, at)
        self.bounds = np.frombuffer(data, "<i8", n_docs + 1, at + 8 * n_docs)
        at += 8 * (2 * n_docs + 1)
        self.levels, one = [], self.width // 8
        for k in range(levels):
            (n,) = struct.unpack_from("<q", data, at)
            chunk = np.frombuffer(data, f"<u{one}", n, at + 8)
            at += 8 + one * n
            if k == levels - 1:
                self.levels.append((chunk, None, None))
                break
            words = np.frombuffer(data, "<u8", -(-n // 64) or 1, at)
            ranks = np.frombuffer(data, "<u4", len(words), at + words.nbytes)
            at += words.nbytes + ranks.nbytes
            self.levels.append((chunk, words, ranks))

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunk, words, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (k * self.width)
            if words is None or not (word := int(words[i >> 6])) >> (i & 63) & 1:
                break
            i = int(ranks[i >> 6]) + (word & ((1 << (i & 63)) - 1)).bit_count()
        return value

    def slice(self, i: int, j: int) -> np.ndarray:
        """Ids i to j - 1; on each level they are a range as well, found by two ranks."""
        out = np.zeros(max(0, j - i), np.uint32)
        place, lo, hi = np.arange(len(out)), i, j
        for k, (chunk, words, ranks) in enumerate(self.levels):
            out[place] |= chunk[lo:hi].astype(np.uint32) << np.uint32(k * self.width)
            if words is None or hi <= lo:
                break
            first = lo >> 6
            bits = np.unpackbits(words[first : (hi + 63) >> 6].view(np.uint8), bitorder="little")
            on = bits[lo - 64 * first : hi - 64 * first].astype(bool)
            lo = int(ranks[first]) + int(bits[: lo - 64 * first].sum())
            place = place[on]
            hi = lo + len(place)
        return out

    def ids(self) -> np.ndarray:
        return self.slice(0, self.n)


class Encoder:
    """Token ids of texts as the tokenizers library gives them, each distinct chunk asked of it once."""

    def __init__(self, path: str):
        self.tok = bytebpe.tokenizer(path)
        self.special = bytebpe.added(path)
        self.cached = bytebpe.Chunked(lambda parts: [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)], CHUNKS)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; a text with an added token's string goes to the library whole."""
        if any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self.cached.values(text))


def write_files(docs: DataFrame, path: str, label: str) -> DataFrame:
    """The files of documents (doc_id, text) in ascending doc_id: part, seq, n_ids, start in the part, data."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        encoder, part, seq, start = kept("dac", path, lambda: Encoder(path)), TaskContext.get().partitionId(), 0, 0
        ids, lengths, held, end = [], [], [], np.array([END], "<u4").tobytes()

        def flush():
            nonlocal seq, start, ids, lengths, held
            n = sum(lengths)
            data = pack(np.frombuffer(b"".join(ids), "<u4"), np.array(held, np.int64), np.concatenate([[0], np.cumsum(lengths)]), start)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([n], pa.int64()), pa.array([start], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_ids", "start", "data"])
            seq, start, ids, lengths, held = seq + 1, start + n, [], [], []
            return row

        size = 0
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = (encoder(text) if text else b"") + end
                if held and size + len(one) > 4 * FILE_IDS:
                    yield flush()
                    size = 0
                ids.append(one)
                lengths.append(len(one) // 4)
                held.append(-(2**63) if doc_id is None else doc_id)
                size += len(one)
        if held:
            yield flush()

    return stored(docs.sparkSession, ordered.mapInArrow(encode, "part int, seq bigint, n_ids bigint, start bigint, data binary"), label)[0]


def with_offsets(files: DataFrame) -> DataFrame:
    """files with `offset`, the ids in all parts before: one sum a part, which are as many as the tasks that wrote."""
    spark, offset, rows = files.sparkSession, 0, []
    for part, n in sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        rows.append((part, offset))
        offset += n
    return files.join(F.broadcast(spark.createDataFrame(rows, "part int, offset bigint")), "part") if rows else files.withColumn("offset", F.lit(0).cast("long"))


def op7_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the files read back."""
    files = with_offsets(write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "dac"))

    def read(batches):
        for b in batches:
            for data, offset in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = Reader(data)
                ids = r.ids().astype("<u4").tobytes()
                cuts = r.bounds.tolist()
                crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                docs = pa.array(r.docs, pa.int64(), mask=r.docs == -(2**63))
                yield pa.RecordBatch.from_arrays([docs, pa.array(r.bounds[:-1] + (offset + r.start)), pa.array(np.diff(r.bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("data", "offset").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


QUERIES = {"op7_dac": op7_dac}
SQL: dict[str, str] = {}
