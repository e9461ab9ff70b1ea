"""Merkle fixity audit of WARC files: hash records and ordered offset ranges into trees, compare roots, descend.

Replicas are stored WARC bytes, one row a file in a table of the shared folder (executors share no other place, and
Spark's committer makes retries safe). Each is read back on its own: a parser cuts a file into records, and from what
it finds the file's tree is built in the same place. A leaf hashes a record's offset range and the SHA-256 of its bytes;
FAN neighbours form a node that hashes its own offset range and its children's hashes, and so on for LEVELS levels, so
truncated, shifted, missing and added records show as well as changed bytes. The nodes are written by replica and
level. An audit joins the top nodes of two replicas and opens of each lower level only what lies below nodes that
differ. At the leaves it says what has become of a record: intact, moved (the same bytes elsewhere in the file),
damaged (other bytes under the same id), missing or added.

Files hold at most FILE_RECORDS records or little more than FILE_BYTES, so no group grows with the data: records go to
files by id range; a range with more than HOT records (repeated or null ids) is dealt to several tasks.

Defined results: null url or html count as empty; null ids have files of their own; repeated rows are records of their
own (which of them is in which file of a hot range isn't defined); bytes that are no record end a file; a file that one
replica lacks is missing or added record by record; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcrawl.llm.common import scratch, slices, stored, table

FILE_RECORDS, FILE_BYTES, FAN, LEVELS = 512, 32 << 20, 8, 4
#: Records of an id range from which on it is dealt out, and rows (of some 30 bytes) up to which a table is broadcast.
HOT, BROADCAST_ROWS = 64 * FILE_RECORDS, 500_000
_SHIFT = FILE_RECORDS.bit_length() - 1


def record(key: int | None, url: str | None, body: str | None) -> bytes:
    """A WARC/1.1 resource record."""
    raw = (body or "").encode("utf-8", "surrogatepass")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if key is None else key}>\r\nWARC-Target-URI: {target}\r\nContent-Type: text/html\r\nContent-Length: {len(raw)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + raw + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of an uncompressed WARC file; ends at bytes that are none."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end == -1:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or len(size) > 18:
            return
        stop = end + 4 + int(size) + 4
        yield at, min(stop, len(data)) - at, headers, data[end + 4 : end + 4 + int(size)]
        at = stop


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree(data: bytes) -> list[list[tuple]]:
    """The levels of a file's tree, from the records up; nodes are (hash, first offset, end), leaves also (id, digest)."""
    leaves = []
    for at, n, headers, _ in parse(data):
        digest = hashlib.sha256(data[at : at + n]).hexdigest()
        leaves.append((_sha(f"{at}:{at + n}:{digest}"), at, at + n, headers.get("warc-record-id", ""), digest))
    levels = [leaves]
    for _ in range(LEVELS):
        below = levels[-1]
        groups = [below[k : k + FAN] for k in range(0, len(below), FAN)]
        levels.append([(_sha(f"{g[0][1]}:{g[-1][2]}:{''.join(x[0] for x in g)}"), g[0][1], g[-1][2]) for g in groups])
    return levels


_FILES = "replica int, file string, data binary"


def in_files(records: DataFrame, copies, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records as WARC files: replica, file, data. copies(records of a file as (key, url, bytes)) gives the replicas' records."""
    grp = F.coalesce(F.shiftright(F.col(key).cast("long"), _SHIFT).cast("string"), F.lit("null"))
    rows = records.select(grp.alias("grp"), F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), F.monotonically_increasing_id().alias("at"))
    hot = records.groupBy(grp.alias("grp")).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("grp", F.ceil(F.col("n") / HOT).cast("int").alias("ways"))
    hot, _ = stored(records.sparkSession, hot, "fixity-hot")
    dealt = rows.join(_bounded(hot), "grp", "left").withColumn("way", F.when(F.col("ways").isNotNull(), F.pmod(F.xxhash64("at"), F.col("ways")).cast("int")))
    ordered = dealt.select("grp", "way", "key", "url", "html").repartition("grp", "way").sortWithinPartitions("grp", "way", "key", "url", "html")

    def run(batches):
        place, held, size, sub = None, [], 0, 0

        def told():
            name = f"{place[0]}-{sub}" if place[1] is None else f"{place[0]}.{place[1]}-{sub}"
            data = [b"".join(x) for x in copies(held)]
            return pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array([name] * len(data)), pa.array(data, pa.binary())], names=["replica", "file", "data"])

        for b in slices(batches):
            for g, way, k, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and ((g, way) != place or len(held) == FILE_RECORDS or size >= FILE_BYTES):
                    yield told()
                    sub = sub + 1 if (g, way) == place else 0
                    held, size = [], 0
                place = (g, way)
                one = record(k, u, h)
                held.append((k, u or "", one))
                size += len(one)
        if held:
            yield told()

    return ordered.mapInArrow(run, _FILES)


def nodes_of(files: DataFrame, label: str) -> DataFrame:
    """All nodes of the trees of files (replica, file, data): replica, level, file, node, hash, first, end, id, digest.

    Written to the shared folder by replica and level; a reader of one level reads no other.
    """

    def run(batches):
        for b in slices(batches, 8):
            rows = []
            for replica, name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for level, nodes in enumerate(tree(data)):
                    rows += [(replica, level, name, k, *(x if level == 0 else (*x, None, None))) for k, x in enumerate(nodes)]
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NODE)

    spark, path = files.sparkSession, scratch(files.sparkSession, label)
    schema = "replica int, level int, file string, node long, hash string, first long, end long, id string, digest string"
    files.select("replica", "file", "data").mapInArrow(run, schema).write.partitionBy("replica", "level").parquet(path)
    return spark.read.schema(schema).parquet(path)


_NODE = ["replica", "level", "file", "node", "hash", "first", "end", "id", "digest"]


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """What differs between two replicas' trees, record by record.

    file, node, id, first, end, digest of our record (null: added), found_first, found_end, found_digest of theirs
    (null: missing), verdict. Only branches whose hashes differ are opened.
    """
    bad = None
    for k in range(LEVELS, 0, -1):
        a, b = (_below(t, k, bad).select("file", "node", F.col("hash").alias(n)) for t, n in ((ours, "ours"), (theirs, "theirs")))
        differing = a.join(b, ["file", "node"], "full").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "node")
        bad = _bounded(stored(ours.sparkSession, differing, f"fixity-level{k}")[0])
    leaf = ["file", "node", "hash", "id", "first", "end", "digest"]
    a, b = _below(ours, 0, bad).select(*leaf), _below(theirs, 0, bad).select("file", "node", "hash", *[F.col(c).alias(f"found_{c}") for c in ("first", "end", "digest")], F.col("id").alias("found_id"))
    pairs = a.join(b.withColumnRenamed("hash", "found_hash"), ["file", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("found_hash")))
    mine = pairs.where(F.col("hash").isNotNull()).select("file", "node", "id", "first", "end", "digest")
    found = pairs.where(F.col("found_hash").isNotNull()).select("file", F.col("found_id").alias("id"), "found_first", "found_end", "found_digest")
    # The same bytes elsewhere, else the same id with other bytes; the first of ours meets the first of theirs.
    nth = lambda df, by, at: df.withColumn("nth", F.row_number().over(Window.partitionBy("file", "id", *by).orderBy(at)))
    same = nth(mine, ["digest"], "first").join(nth(found, ["found_digest"], "found_first").withColumn("digest", F.col("found_digest")), ["file", "id", "digest", "nth"], "full").drop("nth")
    lost, extra = same.where(F.col("found_first").isNull()).select(mine.columns), same.where(F.col("first").isNull()).select(found.columns)
    rest = nth(lost, [], "first").join(nth(extra, [], "found_first"), ["file", "id", "nth"], "full").drop("nth")
    verdict = F.when(F.col("first").isNull(), "added").when(F.col("found_first").isNull(), "missing").otherwise("damaged")
    columns = ["file", "node", "id", "first", "end", "digest", "found_first", "found_end", "found_digest"]
    moved = same.where(F.col("first").isNotNull() & F.col("found_first").isNotNull()).select(*columns, F.lit("moved").alias("verdict"))
    return moved.unionByName(rest.select(*columns, verdict.alias("verdict")))


def _bounded(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has no more than BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _below(nodes: DataFrame, level: int, parents: DataFrame | None) -> DataFrame:
    """Nodes of a level, of all files or below the given parents."""
    own = nodes.where(F.col("level") == level)
    if parents is None:
        return own
    return own.withColumn("up", F.floor(F.col("node") / FAN)).join(parents.withColumnRenamed("node", "up"), ["file", "up"], "left_semi")


def second_replica(records: list[tuple[int | None, str, bytes]]) -> tuple[list[bytes], list[bytes]]:
    """The query's replicas of a file: the records, and what a careless copy makes of them.

    By the first byte of sha256(url): below 4 a record's last byte is changed, below 8 the record is left out, below 12 it
    is written twice, below 16 it stands at the end of the file.
    """
    copy, late = [], []
    for _, url, raw in records:
        b = hashlib.sha256(url.encode("utf-8", "surrogatepass")).digest()[0]
        if b < 4:
            copy.append(raw[:-1] + b"X")
        elif b >= 8:
            (late if 12 <= b < 16 else copy).extend([raw] * (2 if b < 12 else 1))
    return [raw for _, _, raw in records], copy + late


def key_of(id_column: Column) -> Column:
    return F.nullif(F.regexp_extract(id_column, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def op9_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of either replica: page_id, file, its place and digest in both, both top hashes, and the verdict."""
    files, _ = stored(spark, in_files(table(spark, sf_dir, "pages").select("page_id", "url", "html"), second_replica), "fixity-warc", compression="zstd")
    nodes = nodes_of(files, "fixity-nodes")
    ours, theirs = (nodes.where(F.col("replica") == k) for k in (0, 1))
    changes, _ = stored(spark, audit(ours, theirs), "fixity-audit")
    leaves = ours.where(F.col("level") == 0).select("file", "node", "id", "first", "end", "digest")
    hit = changes.where(F.col("node").isNotNull()).select("file", "node", "found_first", "found_end", "found_digest", "verdict")
    known = leaves.join(hit, ["file", "node"], "left")
    sound = F.col("verdict").isNull()
    known = known.select("file", "id", "first", "end", "digest", *[F.when(sound, F.col(c)).otherwise(F.col(f"found_{c}")).alias(f"found_{c}") for c in ("first", "end", "digest")], F.coalesce("verdict", F.lit("intact")).alias("verdict"))
    rows = known.unionByName(changes.where(F.col("node").isNull()).drop("node"))
    top = [t.where((F.col("level") == LEVELS) & (F.col("node") == 0)).select("file", F.col("hash").alias(n)) for t, n in ((ours, "root"), (theirs, "found_root"))]
    out = rows.join(top[0], "file", "left").join(top[1], "file", "left")
    size = lambda a, b: F.col(b) - F.col(a)
    return out.select(
        key_of(F.col("id")).alias("page_id"), "file", F.col("first").alias("offset"), size("first", "end").alias("length"), F.col("digest").alias("sha256"),
        F.col("found_first").alias("found_offset"), size("found_first", "found_end").alias("found_length"), F.col("found_digest").alias("found_sha256"),
        "root", "found_root", "verdict", (F.col("verdict") != "intact").alias("damaged"),
    )


def _levels(side: str) -> str:
    """CTEs of the nodes over leaves_<side> (file, rn, first, last, h), up to <side>4."""
    out = []
    for k in range(LEVELS):
        below = f"leaves_{side}" if k == 0 else f"{side}{k}"
        out.append(f"{side}{k + 1} AS (SELECT file, rn // {FAN} AS rn, min(first) AS first, max(last) AS last, sha256(min(first) || ':' || max(last) || ':' || string_agg(h, '' ORDER BY rn)) AS h FROM {below} GROUP BY file, rn // {FAN})")
    return ",\n".join(out)


_CR = "chr(13) || chr(10)"
_RECORD = f"""'WARC/1.1' || {_CR} || 'WARC-Type: resource' || {_CR} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || {_CR} || 'WARC-Target-URI: ' || coalesce(url, '') || {_CR} || 'Content-Type: text/html' || {_CR} || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || {_CR} || {_CR} || coalesce(html, '') || {_CR} || {_CR}"""

SQL = {
    "op9_fixity": f"""
WITH numbered AS (
  SELECT page_id, coalesce((page_id >> {_SHIFT})::VARCHAR, 'null') AS grp, {_RECORD} AS rec, substr(sha256(coalesce(url, '')), 1, 2) AS b,
    row_number() OVER (PARTITION BY page_id >> {_SHIFT} ORDER BY page_id NULLS FIRST, url NULLS FIRST, html NULLS FIRST) - 1 AS n
  FROM pages),
records AS (SELECT page_id, grp || '-' || (n // {FILE_RECORDS}) AS file, n % {FILE_RECORDS} AS n, rec, b FROM numbered),
theirs AS (
  SELECT page_id, file, n, 0 AS late, 0 AS copy, CASE WHEN b < '04' THEN left(rec, length(rec) - 1) || 'X' ELSE rec END AS rec FROM records WHERE b NOT BETWEEN '04' AND '07' AND b NOT BETWEEN '0c' AND '0f'
  UNION ALL SELECT page_id, file, n, 0, 1, rec FROM records WHERE b BETWEEN '08' AND '0b'
  UNION ALL SELECT page_id, file, n, 1, 0, rec FROM records WHERE b BETWEEN '0c' AND '0f'),
placed_a AS (SELECT page_id, file, sha256(rec) AS digest, row_number() OVER (PARTITION BY file ORDER BY n) - 1 AS rn, (sum(octet_length(encode(rec))) OVER (PARTITION BY file ORDER BY n))::BIGINT AS last, octet_length(encode(rec)) AS size FROM records),
placed_b AS (SELECT page_id, file, sha256(rec) AS digest, row_number() OVER (PARTITION BY file ORDER BY late, n, copy) - 1 AS rn, (sum(octet_length(encode(rec))) OVER (PARTITION BY file ORDER BY late, n, copy))::BIGINT AS last, octet_length(encode(rec)) AS size FROM theirs),
leaves_a AS (SELECT *, last - size AS first, sha256((last - size) || ':' || last || ':' || digest) AS h, row_number() OVER (PARTITION BY file, page_id, digest ORDER BY rn) AS nth FROM placed_a),
leaves_b AS (SELECT *, last - size AS first, sha256((last - size) || ':' || last || ':' || digest) AS h, row_number() OVER (PARTITION BY file, page_id, digest ORDER BY rn) AS nth FROM placed_b),
{_levels("a")},
{_levels("b")},
same AS (
  SELECT coalesce(x.file, y.file) AS file, coalesce(x.page_id, y.page_id) AS page_id, x.first, x.last, x.digest, y.first AS found_first, y.last AS found_last, y.digest AS found_digest
  FROM leaves_a x FULL JOIN leaves_b y ON x.file = y.file AND x.page_id IS NOT DISTINCT FROM y.page_id AND x.digest = y.digest AND x.nth = y.nth),
lost AS (SELECT *, row_number() OVER (PARTITION BY file, page_id ORDER BY first) AS nth FROM same WHERE found_first IS NULL),
extra AS (SELECT *, row_number() OVER (PARTITION BY file, page_id ORDER BY found_first) AS nth FROM same WHERE first IS NULL),
told AS (
  SELECT file, page_id, first, last, digest, found_first, found_last, found_digest, CASE WHEN first = found_first THEN 'intact' ELSE 'moved' END AS verdict FROM same WHERE first IS NOT NULL AND found_first IS NOT NULL
  UNION ALL
  SELECT coalesce(x.file, y.file), coalesce(x.page_id, y.page_id), x.first, x.last, x.digest, y.found_first, y.found_last, y.found_digest, CASE WHEN x.first IS NULL THEN 'added' WHEN y.found_first IS NULL THEN 'missing' ELSE 'damaged' END
  FROM lost x FULL JOIN extra y ON x.file = y.file AND x.page_id IS NOT DISTINCT FROM y.page_id AND x.nth = y.nth)
SELECT page_id, t.file AS file, t.first AS "offset", t.last - t.first AS length, digest AS sha256, found_first AS found_offset, found_last - found_first AS found_length, found_digest AS found_sha256,
  a{LEVELS}.h AS root, b{LEVELS}.h AS found_root, verdict, verdict <> 'intact' AS damaged
FROM told t LEFT JOIN a{LEVELS} ON t.file = a{LEVELS}.file AND a{LEVELS}.rn = 0 LEFT JOIN b{LEVELS} ON t.file = b{LEVELS}.file AND b{LEVELS}.rn = 0
"""
}

QUERIES = {"op9_fixity": op9_fixity}
