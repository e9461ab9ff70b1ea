"""Endpoints over a written index, the answer cache, SQL functions, table creation, verdicts, times, sources."""

import datetime

from pyspark.sql import functions as F

from loomcrawl.functions import dates, registered
from loomcrawl.operators import crawl, frontier, index
from loomcrawl.operators.endpoints import STAYS, Cache, Endpoints


def written(spark, path):
    rows = [
        (1, "Red boats", "red boats sail far", "a.org", "en", "article", 80.0),
        (2, "Blue boats", "blue boats and red sails " * 40, "b.org", "en", "blog", 40.0),
        (3, "Trains", "no water here", "a.org", "fr", "article", 60.0),
        (4, None, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "id long, title string, content string, domain string, language string, content_type string, quality_score double").withColumn("crawled_at", F.to_timestamp(F.lit("2024-01-05")))
    return index.Index.write(docs, str(path), ("title", "content"))


def test_endpoints(spark, tmp_path):
    e = Endpoints(written(spark, tmp_path / "ix"), ("id", "title", "content", "domain"))
    assert [r.status for r in e.health().collect()] == ["healthy"]
    found = e.search({"q": "red boats", "size": "1"})
    assert [(r.id, r.total_hits, r.total_pages) for r in found] == [(1, 2, 2)]
    assert [r.id for r in e.search({"q": "boats", "domains": "b.org, c.org"})] == [2]
    assert len(e.search({"q": "sails"})[0].content) == 503 and e.search({"q": "zebra"}) == []
    facets = {(r.facet, r.key): r.n for r in e.search_facets({"q": "boats"}).collect()}
    assert facets == {("domain", "a.org"): 1, ("domain", "b.org"): 1, ("language", "en"): 2, ("content_type", "article"): 1, ("content_type", "blog"): 1}
    assert [r.title for r in e.suggest("bl").collect()] == ["Blue boats"]
    assert {(r.facet, r.key): r.n for r in e.analytics().collect()}[("domain", "a.org")] == 2
    assert [r.n for r in e.domains(1).collect()] == [2]
    assert e.content("unknown").count() == 0
    assert e.stats().first().docs == 4


def test_an_answer_stays_for_a_while_and_the_cache_is_bounded():
    now, made = [0.0], []
    cache = Cache(most=2, clock=lambda: now[0])
    ask = lambda k: cache.get(k, lambda: made.append(k) or [k])
    assert ask("a") == ask("a") == ["a"] and made == ["a"]
    now[0] = STAYS
    assert ask("a") == ["a"] and made == ["a", "a"]
    ask("b"), ask("c")
    assert list(cache.kept) == ["b", "c"]


def test_sql_functions_are_the_column_functions(spark):
    registered.register(spark)
    rows = [(" HTTP://www.A.example:80/x//y/?b=2&utm_source=q&a=1#f", "Review: buy 'it' \\ now.\n\nSecond line, the end.", "Review"), ("short", "", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "url string, content string, title string").withColumn("html", F.concat(F.lit("<title>T</title><a href=\"/q\">x</a>"), "content")).withColumn("domain", F.lit("a.org"))
    df.createOrReplaceTempView("sql_function_rows")
    for name, (f, names) in registered.FUNCTIONS.items():
        got = spark.sql(f"SELECT {name}({', '.join(names)}) AS o FROM sql_function_rows").collect()
        assert got == df.select(f(*[F.col(n) for n in names]).alias("o")).collect(), name


def test_a_table_is_made_once(spark, tmp_path):
    name = "made_once_for_a_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        assert index.create_index(spark, name, "url string, title string", "url", 4)
        assert not index.create_index(spark, name, "url string, title string", "url", 4)
        assert spark.table(name).columns == ["url", "title"] and spark.table(name).count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_verdicts(spark):
    at = datetime.datetime(2024, 1, 1, 10, 0)
    rows = [("a", 1, at, True, 0), ("b", 2, at, False, 0), ("c", 3, at, True, 0), ("d", 4, at, True, 0), ("a", 5, at + datetime.timedelta(seconds=5), True, 0), (None, 6, at, True, 1)]
    gated = crawl.gate(spark.createDataFrame(rows, "domain string, id int, ts timestamp, allowed boolean, shard int"), 60.0)
    got = {r.id: (r.status, r.wait) for r in crawl.verdicts(gated, 2).collect()}
    assert got == {1: ("scheduled", 0.0), 2: ("rejected", 0.0), 3: ("scheduled", 0.0), 4: ("delayed", 30.0), 5: ("delayed", 55.0), 6: ("error", 0.0)}


def test_shards_over_and_under_their_mean(spark):
    at = datetime.datetime(2024, 1, 1)
    r = crawl.imbalance(spark.createDataFrame([(s, at) for s, n in ((0, 10), (1, 4), (2, 1)) for _ in range(n)], "shard int, ts timestamp")).first()
    assert (r.over_loaded, r.under_loaded, r.act) == (1, 1, True)
    none = crawl.imbalance(spark.createDataFrame([], "shard int, ts timestamp")).first()
    assert (none.over_loaded, none.under_loaded, none.most) == (0, 0, None)


def test_times_as_strings(spark):
    df = spark.createDataFrame([("2024-02-29T23:59:59.000001",), ("1969-12-31T23:59:59",), ("not a time",), (None,)], "s string")
    got = df.select(dates.iso(dates.from_iso(F.col("s"))).alias("s"), dates.micros(dates.from_iso(F.col("s"))).alias("m")).collect()
    assert [tuple(r) for r in got] == [("2024-02-29T23:59:59.000001", 1709251199000001), ("1969-12-31T23:59:59", -1000000), (None, None), (None, None)]


def test_sources_queue_and_inbound_links(spark):
    urls = lambda *u: spark.createDataFrame([(x, 0, i) for i, x in enumerate(u)], "url string, depth int, created_at long")
    both = frontier.from_sources({"seed": urls("https://a.example/p"), "found": urls("https://b.example/q", "https://a.example/p/")})
    got = {(r.source, r.url): r.status for r in frontier.admit(both).collect()}
    assert got == {("seed", "https://a.example/p"): "new", ("found", "https://b.example/q"): "new", ("found", "https://a.example/p/"): "exact"}
    queue = spark.createDataFrame([(1, "pending", 5), (2, "done", 6), (3, "pending", 7)], "url_id int, status string, scheduled_at int")
    known = spark.createDataFrame([(1, "u1"), (2, "u2")], "url_id int, normalized_url string")
    assert [tuple(r) for r in frontier.queued(queue, known).collect()] == [(1, 5, "u1")]
    links = spark.createDataFrame([("s1", "t", "x"), ("s1", "t", "y"), ("s2", "t", None), ("s2", "w", "z")], "source_url string, target_url string, anchor_text string")
    docs = spark.createDataFrame([("t",), ("t",)], "url string")
    assert {tuple(r) for r in index.inbound(links, docs).collect()} == {("t", 3, 2, "x", True), ("w", 1, 1, "z", False)}
