"""Joining texts whose word 5-gram sets have a Jaccard similarity of 0.75 or more: size-aware, light and heavy.

Sets are of 64-bit shingle hashes; equal sets are one class from the start, so copies are never compared. All sets
order their shingles alike: by hash, but those found often in the corpus last, by count. Any such order is right, so
the counts only make it fast; they come from all texts, for the shingles that such an order puts first.

* Light sets (at most `boundary` shingles) enumerate the 2-subsets of their prefix: sets that overlap enough share two
  of the first s - ceil(0.75 s) + 2 shingles.
* Heavy sets go into inverted lists by the s - ceil(0.75 s) + 1 first shingles; a list is scanned for sets of fitting
  size. Light sets that a heavy one can match enter the lists with their first s - ceil(6/7 s) + 1.
* The boundary is where the subsets cost more than a prefix and the scans of its lists do, by the mean list length
  that the counts tell.

Lists are dealt out by hash as packed arrays. Every list has a centre, the member that is in most lists; a centre and
all that share a list with it form a group, whose members' sets meet in one place and are compared there exactly, in
blocks of BLOCK members if they are many. Two sets that share a list are in its centre's group, so no link is missed;
a group returns no pairs but a spanning star of each of its components. A set travels once for each centre it shares
a list with, mostly one, and not once for each partner.

Sets that share a list by chance, of which a larger corpus has more than its share, don't travel: sketches do first,
some 1/20 of a set's size. A sketch counts a set's shingles by bits of their hash, and two sets differ in at least as
many shingles as their sketches' counts differ by. Linked sets of a and b shingles differ in (a + b) / 7 at most, so a
member whose sketch is further from every other's in its group has no link there.

Shingle hashes have 64 bits: two different shingles of a text pair fall together about once in 10^13 pairs.

Defined results: null text or text without words has an empty set, n_shingles 0, and is linked with nothing; fewer
than five words are one shingle; equal rows are in one component; rows with a null doc_id are linked like any other,
and a component of such rows alone has a null component_id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.llm.common import Recent, discard, input_bytes, kept, map_batches, slices, spread_keys, stored, table
from loomcrawl.llm.components import components

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Shingles whose hash is in this share of all are counted, by 32 bits; of those in OFTEN sets or more the HEAVY most
#: frequent are ordered last.
COUNTED, OFTEN, HEAVY = 0.4, 4, 1 << 18
#: Light sets have at most so many shingles, whatever the costs say: keeps a set's subsets below 200.
MOST_LIGHT = 64
#: Distinct words a task keeps, numbers it holds before it deals them out, bytes dealt to a partition, members of a block
#: of a group.
CACHE, HELD, PART_BYTES, BLOCK = 200_000, 1 << 20, 32 << 20, 512
#: Pieces of a Bloom filter, united each in a place of its own.
PIECES = 16
#: Size codes: 256 a doubling; sizes that fit differ by at most RATIO codes.
_CODE, RATIO = 256, 107
_U = np.uint64


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self) -> None:
        self.words = Recent(CACHE, _word_hash)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, _U)
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, _U)
        w = np.fromiter(map(self.words.__getitem__, words), _U, len(words))
        n, k = max(1, len(w) - WORDS + 1), min(WORDS, len(w))
        h = np.full(n, k, _U)
        for i in range(k):
            h = _mix(h + w[i : i + n] + _U(0x9E3779B97F4A7C15))
        return np.unique(h)


def key_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def probe_prefix(s: int) -> int:
    """Shingles of a set that must include one of any linked set's."""
    return s - -(-NUMERATOR * s // DENOMINATOR) + 1


def index_prefix(s: int) -> int:
    """The same where the other set is at least as large: the overlap is then at least 2 * 75 / 175 of s."""
    return s - -(-2 * NUMERATOR * s // (NUMERATOR + DENOMINATOR)) + 1


def boundary(mean_list: float) -> int:
    """The largest size whose 2-subsets cost no more than its prefix's entries and the scans of their lists."""
    b = 1
    while b < MOST_LIGHT and math.comb(probe_prefix(b + 1) + 1, 2) <= probe_prefix(b + 1) * (1 + mean_list):
        b += 1
    return b


class Dealer:
    """Arrays of one length that a task collects and deals out to partitions as packed rows (part, data, ...)."""

    def __init__(self, parts: list[int], columns: int):
        self.keys, self.n, self.held, self.size = pa.array(parts, pa.int32()), len(parts), [[] for _ in range(columns)], 0

    def add(self, *arrays: np.ndarray) -> None:
        for held, x in zip(self.held, arrays, strict=True):
            held.append(x)
        self.size += len(arrays[0])

    def full(self) -> bool:
        return self.size >= HELD

    def dealt(self, place) -> tuple[pa.Array, list[pa.Array]]:
        """Partition keys and packed columns of all that is held; place(first array) gives partition numbers."""
        columns = [np.concatenate(held) for held in self.held]
        self.held, self.size = [[] for _ in self.held], 0
        part = place(columns[0])
        at = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[at], np.arange(self.n + 1))
        some = np.flatnonzero(np.diff(cuts))
        return self.keys.take(pa.array(some)), [pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary()) for x in (c[at] for c in columns)]


def _unpacked(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist() if x]


def sketch(x: np.ndarray) -> bytes:
    """Counts of a set's shingles by the last bits of their hash, a byte each: 16 at least, 2 to 4 shingles a count."""
    k = max(16, 1 << (len(x) // 4).bit_length())
    return np.minimum(np.bincount((x & _U(k - 1)).astype(np.int64), minlength=k), 255).astype(np.uint8).tobytes()


def near(sketches: list[bytes], sizes: list[int]) -> np.ndarray:
    """Which of some sets may be linked with another one of them, by their sketches."""
    out, n, ks = np.zeros(len(sketches), bool), np.array(sizes, np.int64), np.array([len(x) for x in sketches])
    levels = np.unique(ks)
    at = {k: np.flatnonzero(ks == k) for k in levels.tolist()}
    counts = {k: np.frombuffer(b"".join(sketches[i] for i in at[k]), np.uint8).reshape(-1, k).astype(np.int16) for k in at}
    for k, own in at.items():
        # Sizes that fit differ by less than a doubling, so counts do by one at most.
        for other, of in [(own, counts[k])] + ([(at[2 * k], counts[2 * k][:, :k] + counts[2 * k][:, k:])] if 2 * k in at else []):
            for row, i in zip(counts[k], own.tolist(), strict=True):
                fits = 7 * np.abs(of - row).sum(axis=1, dtype=np.int64) <= n[other] + n[i]
                fits &= other != i
                if fits.any():
                    out[i] = True
                    out[other[fits]] = True
    return out


#: row: a hash of the text, which with the doc_id tells rows apart.
_SCAN = "kind int, doc_id long, row long, n long, key long, sketch binary"
_SCANNED = ["kind", "doc_id", "row", "n", "key", "sketch"]


def scan(docs: DataFrame, parts: list[int]) -> DataFrame:
    """Of every row doc_id, row, n, key (kind 0; null key: empty set); of frequent shingles 32 bits and count (kind 1: key, n).

    A key's first row in a task has its sketch.
    """
    counted, n_parts = _U(int(COUNTED * 2**32)), len(parts)

    def run(batches):
        shingler, dealer, seen = kept("shingler", 0, Shingler), Dealer(parts, 1), set()

        def told():
            part, [data] = dealer.dealt(lambda x: (_mix(x.astype(_U)) % _U(n_parts)).astype(np.int64))
            k = len(part)
            return pa.RecordBatch.from_arrays([part, pa.array([1] * k, pa.int32()), *[pa.nulls(k, pa.int64())] * 4, pa.nulls(k, pa.binary()), data], names=["part", *_SCANNED, "data"])

        for b in slices(batches):
            ns, keys, sketches = [], [], []
            for t in b.column(1).to_pylist():
                x = shingler(t)
                ns.append(len(x))
                keys.append(key_of(x) if len(x) else None)
                sketches.append(None)
                if len(x) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    sketches[-1] = sketch(x)
                    h = x >> _U(32)  # sorted, as x is
                    dealer.add(h[: np.searchsorted(h, counted)].astype(np.uint32))
            if dealer.full():
                yield told()
            part = dealer.keys.take(pa.array((_mix(np.array(ns, _U) * _U(977) + np.arange(len(ns), dtype=_U)) % _U(n_parts)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part, pa.array([0] * b.num_rows, pa.int32()), b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(b.num_rows, pa.binary())], names=["part", *_SCANNED, "data"])
        if dealer.size:
            yield told()

    def count(batches):
        own = []
        for b in batches:
            own += _unpacked(b.column(7), np.uint32)
            b = b.filter(pa.compute.equal(b.column(1), 0))
            yield pa.RecordBatch.from_arrays(b.columns[1:7], names=_SCANNED)
        if own:
            h, n = np.unique(np.concatenate(own), return_counts=True)
            h, n = h[n >= OFTEN].astype(np.int64), n[n >= OFTEN].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), *[pa.nulls(len(h), pa.int64())] * 2, pa.array(n), pa.array(h), pa.nulls(len(h), pa.binary())], names=_SCANNED)

    rows = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"part int, {_SCAN}, data binary")
    return rows.repartition(len(parts), "part").mapInArrow(count, _SCAN)


class Order:
    """The corpus-wide order of shingles: by hash, but frequent ones last, by count. heavy: their hashes' first 32 bits."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray):
        at = np.argsort(heavy)
        self.heavy, self.rank = heavy[at].astype(np.uint32), np.log2(np.maximum(counts[at], 2)).astype(np.int8) + np.int8(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not len(self.heavy):
            return x
        h = (x >> _U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.heavy, h), len(self.heavy) - 1)
        often = self.heavy[at] == h
        if not often.any():
            return x
        return x[np.argsort(np.where(often, self.rank[at], 0), kind="stable")]


def entries(x: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """List hashes of an ordered set, and which of them count as index entries."""
    s = len(x)
    if s > light:
        x = x[: probe_prefix(s)]
        return x, np.arange(len(x)) < index_prefix(s)
    head = x[: probe_prefix(s) + 1]
    i, j = np.triu_indices(len(head), 1)
    low, high = np.minimum(head[i], head[j]), np.maximum(head[i], head[j])
    pairs = _mix(_mix(low + _U(0x51ED270B)) + high)
    single = x[: index_prefix(s)] if DENOMINATOR * s >= NUMERATOR * (light + 1) else x[:0]
    return np.concatenate([pairs, single]), np.ones(len(pairs) + len(single), bool)


def dealt(docs: DataFrame, order: Order, light: int, parts: list[int]) -> DataFrame:
    """Packed list entries: part, and two arrays of 64 bits: 48 of the list's hash, size code and index flag; the key."""
    n_parts = len(parts)

    def run(batches):
        shingler, dealer, seen = kept("shingler", 0, Shingler), Dealer(parts, 2), set()

        def told():
            part, data = dealer.dealt(lambda a: (_mix(a >> _U(16)) % _U(n_parts)).astype(np.int64))
            return pa.RecordBatch.from_arrays([part, *data], names=["part", "heads", "owners"])

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                x = shingler(t)
                if not len(x) or (key := key_of(x)) in seen:
                    continue
                seen.add(key)
                h, index = entries(order(x), light)
                if len(h):
                    code = int(math.log2(len(x)) * _CODE)
                    dealer.add((h & ~_U(0xFFFF)) | _U(code << 1) | index.astype(_U), np.full(len(h), key, np.int64))
                if dealer.full():
                    yield told()
        if dealer.size:
            yield told()

    return docs.select("text").mapInArrow(run, "part int, heads binary, owners binary")


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.lexsort(columns[::-1])
    columns = tuple(c[at] for c in columns)
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[new] for c in columns)


def scanned(a: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries of whole lists: the members of each list with a pair that may be linked, as (list, member).

    A list is named by a hash of its members; lists with the same members come once.
    """
    a, o = _distinct(a, o)
    if len(a) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    head, code, index = a >> _U(16), ((a >> _U(1)) & _U(0x7FFF)).astype(np.int64), (a & _U(1)).astype(bool)
    same = head[1:] == head[:-1]
    # Sorted by size: an entry without a neighbour of fitting size in its list has no partner there.
    near = same & (code[1:] - code[:-1] <= RATIO)
    keep = np.concatenate([[False], near]) | np.concatenate([near, [False]])
    # Nor has a list without an index entry.
    group = np.cumsum(np.concatenate([[0], ~same]))
    keep &= np.bincount(group, index)[group] > 0
    head, o = head[keep], o[keep]
    if not len(o):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    size = np.diff(np.append(first, len(head)))
    name = np.add.reduceat(_mix(o.view(_U)), first)
    once = np.zeros(len(size), bool)
    once[np.unique(name, return_index=True)[1]] = True
    rows = np.repeat(once & (size > 1), size)
    return np.repeat(name, size)[rows].view(np.int64), o[rows]


def lists(packed: DataFrame, parts: int) -> DataFrame:
    """list, member of all lists, per partition of lists."""

    def run(batches):
        heads, owners = [], []
        for b in batches:
            heads += _unpacked(b.column(1), _U)
            owners += _unpacked(b.column(2), np.int64)
        if heads:
            names, members = scanned(np.concatenate(heads), np.concatenate(owners))
            for at in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 100_000]), pa.array(members[at : at + 100_000])], names=["list", "member"])

    return packed.repartition(parts, "part").mapInArrow(run, "list long, member long")


def grouped(members: DataFrame) -> DataFrame:
    """centre, member: all that share a list with its centre, the centre among them."""
    degree = members.groupBy("member").agg(F.count("*").alias("degree"))
    once = members.distinct()
    centre = once.join(degree, "member").groupBy("list").agg(F.max(F.struct("degree", "member")).alias("c")).select("list", F.col("c.member").alias("centre"))
    return once.join(centre, "list").select("centre", "member").distinct()


def filter_of(ids: DataFrame) -> bytes:
    """A Bloom filter over a long column: ten bits an id, 128 KB to 32 MB (past it more rows pass, none is missed).

    Tasks build filters of their own, whose pieces are united on the executors; the driver gets each piece once.
    """
    bits = 1 << max(20, min(28, (10 * ids.count()).bit_length()))
    piece = bits // 8 // PIECES

    def build(batches):
        found = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for place in _places(b.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(found, place >> 3, (1 << (place & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([found[k * piece : (k + 1) * piece].tobytes() for k in range(PIECES)], pa.binary())], names=["piece", "bits"])

    def unite(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                total[k] = total[k] | x if k in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["piece", "bits"])

    some = ids.where(ids[ids.columns[0]].isNotNull()).coalesce(8).mapInArrow(build, "piece int, bits binary")
    rows = some.repartition(PIECES, "piece").mapInArrow(unite, "piece int, bits binary").collect()
    return b"".join(r.bits for r in sorted(rows, key=lambda r: r.piece)) if rows else bytes(bits // 8)


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    x = _mix(ids.view(_U))
    return [((x >> _U(k)) % _U(bits)).astype(np.int64) for k in (0, 21, 40)]


def passes(found: bytes, ids: np.ndarray) -> np.ndarray:
    bits, out = np.frombuffer(found, np.uint8), np.ones(len(ids), bool)
    for place in _places(ids, len(found) * 8):
        out &= (bits[place >> 3] >> (place & 7) & 1).astype(bool)
    return out


def sets_of(docs: DataFrame, found: bytes) -> DataFrame:
    """key and shingles (packed) of the rows whose doc_id is null or passes the filter, once a task and key."""

    def make():
        shingler, seen = kept("shingler", 0, Shingler), set()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = b.column(0)
            inside = passes(found, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            keys, data = [], []
            for t in b.column(1).filter(pa.array(inside)).to_pylist():
                x = shingler(t)
                if len(x) and (k := key_of(x)) not in seen:
                    seen.add(k)
                    keys.append(k)
                    data.append(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["key", "shingles"])

        return step

    return map_batches(docs.select("doc_id", "text"), "key long, shingles binary", make)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over the shingles that several sets have, some thousand at a time."""
    n = len(sets)
    total = np.zeros((n, n), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    at = np.argsort(flat, kind="stable")
    flat, owner = flat[at], owner[at]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.append(start, len(flat)))
    many = np.repeat(size > 1, size)
    owner, column = owner[many], np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, (low, low + 2048))
        m = np.zeros((n, 2048), np.float32)
        m[owner[lo:hi], column[lo:hi] - low] = 1
        total += m @ m.T
    return total


def stars(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning star (least place, place) of every component of linked sets."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    if n < 2:
        return []
    if n == 2:
        x, y = sorted(sets, key=len)
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return [(0, 1)] if DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both) else []
    both = overlaps(sets).astype(np.int64)  # exact: sizes stay far below 2^24
    linked = DENOMINATOR * both >= NUMERATOR * (sizes[:, None] + sizes[None, :] - both)
    out, left = [], np.ones(n, bool)
    for i in range(n):
        if left[i]:
            left[i], front = False, [i]
            while front:
                for j in np.flatnonzero(linked[front.pop()] & left).tolist():
                    left[j] = False
                    out.append((i, j))
                    front.append(j)
    return out


def placed(groups: DataFrame) -> DataFrame:
    """centre, i, j, member: where members of groups (centre, member) meet.

    A group of more than BLOCK members is cut into blocks, and each two blocks meet in a place of their own.
    """
    size = groups.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where(F.col("blocks") > 1)
    cut = groups.join(size, "centre", "left").withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")).otherwise(0))
    others = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))).otherwise(F.array(F.lit(0)))
    return cut.withColumn("other", F.explode(others)).select("centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "member")


def met(places: DataFrame, of_key: DataFrame, columns: list[str], schema: str, told) -> DataFrame:
    """told(place, members, values) of each place's members and their columns in of_key, the sets without company left out."""
    # Neither side has a bound, so neither is broadcast, however small it happens to be.
    rows = places.hint("merge").join(of_key, places.member == of_key.key).select("centre", "i", "j", "member", *columns).repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "member")

    def run(batches):
        place, members, held = None, [], []
        for b in slices(batches):
            for *at, member, value in zip(*(c.to_pylist() for c in b.columns[:4]), zip(*(c.to_pylist() for c in b.columns[4:]), strict=True), strict=True):
                if at != place:
                    if len(held) > 1:
                        yield told(place, members, held)
                    place, members, held = at, [], []
                if not members or members[-1] != member:  # several tasks may have sent a set
                    members.append(member)
                    held.append(value)
        if len(held) > 1:
            yield told(place, members, held)

    return rows.mapInArrow(run, schema)


def hopeful(groups: DataFrame, sketches: DataFrame) -> DataFrame:
    """The places of groups with the members that may have a link there, by sketches (key, n, sketch)."""

    def told(place, members, held):
        some = [m for m, may in zip(members, near([x for _, x in held], [n for n, _ in held]), strict=True) if may]
        return pa.RecordBatch.from_arrays([*[pa.array([v] * len(some), t) for v, t in zip(place, (pa.int64(), pa.int32(), pa.int32()), strict=True)], pa.array(some, pa.int64())], names=["centre", "i", "j", "member"])

    return met(placed(groups), sketches, ["n", "sketch"], "centre long, i int, j int, member long", told)


def links_in(places: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that span the components of each place of (centre, i, j, member)."""

    def told(place, members, held):
        found = stars([np.frombuffer(x, _U) for (x,) in held])
        return pa.RecordBatch.from_arrays([pa.array([members[i] for i, _ in found], pa.int64()), pa.array([members[j] for _, j in found], pa.int64())], names=["a", "b"])

    return met(places, sets, ["shingles"], "a long, b long", told)


def classified(docs: DataFrame, label: str) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, row (hash of the text), n and key (of the set; null: empty) of every row of docs; node and root of linked keys."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told, _ = stored(spark, scan(docs, spread_keys(spark, max(at_least, input_bytes(docs) // PART_BYTES))), f"{label}-scan")
    ids = told.where("kind = 0").select("doc_id", "row", "n", "key")
    often = told.where("kind = 1").select("key", "n")
    classes = ids.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    total, prefixes = classes.agg(F.sum("n"), F.sum(F.ceil(F.col("n") / 4) + 1)).first()
    if not total:
        return ids, None
    top = often.orderBy(F.col("n").desc(), "key").limit(HEAVY).collect()
    order = Order(np.array([r.key for r in top], np.int64), np.array([r.n for r in top], np.int64))
    light = boundary(1 + sum(r.n * (r.n - 1) for r in top) / (COUNTED * total))
    parts = max(at_least, math.ceil(int(prefixes) * 16 / PART_BYTES))
    found, found_at = stored(spark, lists(dealt(docs, order, light, spread_keys(spark, parts)), parts), f"{label}-lists")
    groups, groups_at = stored(spark, grouped(found), f"{label}-groups")
    discard(spark, found_at)
    sketches = told.where("sketch is not null").select("key", "n", "sketch")
    places, places_at = stored(spark, hopeful(groups, sketches), f"{label}-places")
    discard(spark, groups_at)
    reps = classes.join(places.select(F.col("member").alias("key")).distinct(), "key", "left_semi").select("rep")
    links, _ = stored(spark, links_in(places, sets_of(docs, filter_of(reps))), f"{label}-links")
    discard(spark, places_at)
    return ids, components(spark, links, f"{label}-round")


def similar(docs: DataFrame, label: str = "jaccard") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row of docs (doc_id, text)."""
    ids, roots = classified(docs, label)
    if roots is None:
        return ids.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    classes = ids.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"))
    rooted = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_key = rooted.join(least, "root").select(F.col("key").alias("k"), "component_id")
    return ids.join(of_key, F.col("key") == F.col("k"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return similar(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: exactly one row of each component stays, that with the smallest doc_id (nulls last).

    Among texts that share this doc_id the one with the smallest hash stays, among equal rows any one; rows without words
    all stay.
    """
    ids, roots = classified(docs, "pipeline-jaccard")
    if roots is None:
        return docs
    counted = ids.where(F.col("key").isNotNull()).groupBy("key", "doc_id", "row").agg(F.count("*").alias("copies"))
    pairs = counted.join(roots, F.col("key") == F.col("node"), "left").select(F.coalesce("root", "key").alias("root"), "doc_id", "row", "copies")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = pairs.groupBy("root").agg(F.min(first).alias("best")).withColumnRenamed("root", "of")
    judged, _ = stored(docs.sparkSession, pairs.join(best, F.col("root") == F.col("of")).select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"), "copies", first.eqNullSafe(F.col("best")).alias("stays")).where(~F.col("stays") | (F.col("copies") > 1)), "pipeline-judged")
    # Most rows aren't judged, as the filter shows: their texts stay where they are, the others' go to the join.
    found, keyed = filter_of(judged.select("of_row")), docs.withColumn("_row", F.xxhash64("text"))
    joined = screened(keyed, found, True).join(judged, F.col("doc_id").cast("long").eqNullSafe(F.col("of_id")) & (F.col("_row") == F.col("of_row")), "left")
    single = screened(keyed, found, False).select(*docs.columns).unionByName(joined.where(F.col("of_row").isNull()).select(*docs.columns))
    # Rows that are kept but repeated, mostly few: one of each.
    return single.unionByName(joined.where("stays").dropDuplicates(["doc_id", "_row"]).select(*docs.columns))


def screened(keyed: DataFrame, found: bytes, inside: bool) -> DataFrame:
    """The rows whose _row passes the filter, or those whose doesn't."""
    at = keyed.columns.index("_row")

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.filter(pa.array(passes(found, b.column(at).to_numpy(zero_copy_only=False)) == inside))

        return step

    return map_batches(keyed, keyed.schema, make)


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([concat_ws(' ', x[1], x[2], x[3], x[4], x[5]) for x in list_zip(w, w[2:], w[3:], w[4:], w[5:], true)]) END AS sh FROM words),
keyed AS (SELECT doc_id, len(sh) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS key, sh FROM sets),
classes AS (SELECT key, min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM keyed WHERE n > 0 GROUP BY key),
entries AS (SELECT key, n, unnest([hash(x) for x in sh]) AS s FROM classes),
links AS (
  SELECT a.key AS x, b.key AS y FROM entries a JOIN entries b ON a.s = b.s AND a.key < b.key AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.key, b.key, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(key, other) AS (SELECT key, key FROM classes UNION SELECT r.key, e.y FROM reach r JOIN edges e ON r.other = e.x),
roots AS (SELECT r.key, min(c.rep) AS component_id FROM reach r JOIN classes c ON r.other = c.key GROUP BY r.key)
SELECT k.doc_id AS doc_id, k.n AS n_shingles, coalesce(r.component_id, k.doc_id) AS component_id FROM keyed k LEFT JOIN roots r ON k.key = r.key AND k.n > 0
"""
}
