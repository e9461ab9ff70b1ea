"""op9: replicas that were changed by hand, odd ids, hot id ranges, and the query against its SQL."""

import collections
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomcrawl.llm import common, fixity

RECORDS = [fixity.record(k, f"http://h/{k}", f"<p>é {k}" * (k % 7)) for k in range(600)]


def audited(spark, ours: dict, theirs: dict):
    rows = [(r, name, bytes(data)) for r, files in enumerate((ours, theirs)) for name, data in files.items()]
    nodes = fixity.nodes_of(spark.createDataFrame(rows, fixity._FILES), "test")
    found = fixity.audit(*(nodes.where(F.col("replica") == k) for k in (0, 1))).collect()
    return sorted((r.file, r.verdict, r.first if r.first is not None else r.found_first) for r in found)


def at(k, records=RECORDS):
    return sum(map(len, records[:k]))


def test_parse():
    data = b"".join(RECORDS)
    got = list(fixity.parse(data))
    assert [data[o : o + n] for o, n, _, _ in got] == RECORDS and got[5][3] == ("<p>é 5" * 5).encode() and got[5][2]["warc-target-uri"] == "http://h/5"
    for odd in (b"", b"WARC/", b"WARC/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: \xb2\r\n\r\n", b"WARC/1.1\r\nContent-Length: 99\r\n\r\nab"):
        list(fixity.parse(odd))
    assert list(fixity.parse(fixity.record(1, "a\r\nContent-Length: 0\r\n\r\n", "b")))[0][3] == b"b"


def test_intact(spark):
    assert audited(spark, {"a": b"".join(RECORDS)}, {"a": b"".join(RECORDS)}) == []


def test_changed_bytes(spark):
    data = bytearray(b"".join(RECORDS))
    for k in (1, 78, 599):
        data[at(k) + len(RECORDS[k]) - 5] ^= 1
    assert audited(spark, {"a": b"".join(RECORDS), "b": b"".join(RECORDS)}, {"a": data, "b": b"".join(RECORDS)}) == [("a", "damaged", at(1)), ("a", "damaged", at(78)), ("a", "damaged", at(599))]


def test_truncated_and_lost(spark):
    whole, cut = b"".join(RECORDS), b"".join(RECORDS[:100]) + RECORDS[100][:-9]
    got = collections.Counter((f, v) for f, v, _ in audited(spark, {"a": whole, "b": whole}, {"a": cut, "c": whole}))
    assert got == {("a", "damaged"): 1, ("a", "missing"): 499, ("b", "missing"): 600, ("c", "added"): 600}


def test_left_out_and_twice(spark):
    gone, twice = [*RECORDS[:590], *RECORDS[591:]], [*RECORDS[:595], RECORDS[595], *RECORDS[595:]]
    got = audited(spark, {"a": b"".join(RECORDS), "b": b"".join(RECORDS)}, {"a": b"".join(gone), "b": b"".join(twice)})
    assert collections.Counter((f, v) for f, v, _ in got) == {("a", "missing"): 1, ("a", "moved"): 9, ("b", "added"): 1, ("b", "moved"): 4}
    assert ("a", "missing", at(590)) in got


def test_swapped(spark):
    swapped = list(RECORDS)
    swapped[3], swapped[4] = swapped[4], swapped[3]
    assert [v for _, v, _ in audited(spark, {"a": b"".join(RECORDS)}, {"a": b"".join(swapped)})] == ["moved", "moved"]


def test_only_differing_branches_are_opened(spark):
    """Nodes below branches that agree are never asked for: with those removed the audit says the same."""
    data = bytearray(b"".join(RECORDS))
    data[at(300) + 80] ^= 1
    nodes = fixity.nodes_of(spark.createDataFrame([(0, "a", b"".join(RECORDS)), (1, "a", bytes(data))], fixity._FILES), "test")
    below = (F.col("level") == fixity.LEVELS) | (F.floor(F.col("node") / fixity.FAN) == F.floor(F.lit(300) / F.pow(F.lit(fixity.FAN), F.col("level") + 1)))
    some = nodes.where(below)
    assert some.count() < 80
    assert [(r.verdict, r.first) for r in fixity.audit(*(some.where(F.col("replica") == k) for k in (0, 1))).collect()] == [("damaged", at(300))]


PAGES = [(1, "u", "<p>x</p>"), (2, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "a"), (None, None, None), (None, "w", "b"), (-1, "x", "é"), (-5, "y", "c"), (700, "z", "<b"), (10**15, "q", "x" * 100_000)]


@pytest.fixture()
def odd(spark, tmp_path):
    rows = PAGES + [(5000 + k, f"http://h/{k}", "body " * (k % 9)) for k in range(1500)]
    spark.createDataFrame([(*r, "e", 0) for r in rows], "page_id long, url string, html string, file string, replica int").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path), rows


def test_query_against_sql(spark, odd):
    path, rows = odd
    got = fixity.op9_fixity(spark, path).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    want = con.execute(fixity.SQL["op9_fixity"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert {r.verdict for r in got} == {"intact", "moved", "damaged", "missing", "added"}
    kind = lambda u: hashlib.sha256((u or "").encode()).digest()[0] // 4
    for verdict, code in (("damaged", 0), ("missing", 1), ("added", 2)):
        assert sum(r.verdict == verdict for r in got) == sum(kind(u) == code for _, u, _ in rows)
    files = {r.page_id: {x.file for x in got if x.page_id == r.page_id} for r in got}
    assert files[-1] == files[-5] == {"-1-0"} and files[None] == {"null-0"}


def test_hot_range(spark, monkeypatch):
    monkeypatch.setattr(fixity, "HOT", 100)
    rows = [(None, f"u{k % 3}", "x") for k in range(1000)] + [(k, "u", "y") for k in range(50)]
    files = fixity.in_files(spark.createDataFrame(rows, "page_id long, url string, html string"), lambda held: ([x[2] for x in held],))
    got = {r.file: len(list(fixity.parse(r.data))) for r in files.collect()}
    assert sum(got.values()) == 1050 and got["0-0"] == 50 and len(got) == 11 and max(got.values()) <= 200


def test_no_local_scratch_on_a_cluster():
    class Context:
        master = "spark://h:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        common.scratch(Session(), "x")
