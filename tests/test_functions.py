import datetime

import pytest
from pyspark.sql import functions as F

from loomcrawl.functions import extract, html, text, urls
from loomcrawl.operators import crawl, frontier, index
from loomcrawl.sources import fetch
from loomcrawl.streaming import jobs

#: One rule of the canonical form each.
URLS = [
    ("https://news.test", "https://news.test/"),
    ("  http://Garden.Test/Roses/ ", "https://garden.test/Roses"),
    ("HTTPS://WWW.garden.test:443/Roses", "https://garden.test/Roses"),
    ("http://garden.test:80/a//b///c", "https://garden.test/a/b/c"),
    ("garden.test/soil;v=3", "https://garden.test/soil"),
    ("https://garden.test/soil?z=9&k=4&fbclid=77&c", "https://garden.test/soil?k=4&z=9"),
    ("https://garden.test/?utm_medium=mail#top", "https://garden.test/"),
    ("https://garden.test/list?page=3", "https://garden.test/list?page=3"),
    ("https://garden.test/rose.JPG", None),
    ("https://garden.test/rose.html", "https://garden.test/rose.html"),
    ("a.b/c", None),
    (" ", None),
    (None, None),
    ("", None),
]


def one(spark, *columns, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(*columns).first()


def test_normalize(spark):
    rows = spark.createDataFrame(URLS, "url string, want string").select("want", urls.normalize(F.col("url")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    again = spark.createDataFrame([(u,) for _, u in URLS if u], "url string").select("url", urls.normalize(F.col("url")).alias("got")).collect()
    assert all(r.url == r.got for r in again)


def test_links(spark):
    base = "https://example.com/a/b"
    cases = [("/home", "https://example.com/home"), ("c", "https://example.com/a/c"), ("//x.org/y/", "https://x.org/y"), ("mailto:a@b.c", None), ("https://facebook.com/x", None), ("/f.pdf", None), ("#top", "https://example.com/a/b")]
    rows = spark.createDataFrame([(h, base, w) for h, w in cases], "h string, b string, want string").select("want", urls.link_target(F.col("h"), F.col("b")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_metadata(spark):
    page = '<html lang="pt"><head><title> Roses  </title><meta name="description" content="How they grow"><link rel="canonical" href="https://garden.test/r"></head><body><a href="/soil">s</a><img src="r.png"><a href="/sun">u</a><a href="/rain">r</a></body></html>'
    h = F.col("h")
    r = one(spark, F.trim(html.title(h)), html.meta(h, "description", 500), html.lang(h), html.canonical(h), html.count_links(h), html.count_images(h), h=page)
    assert list(r) == ["Roses", "How they grow", "pt", "https://garden.test/r", 3, 1]


@pytest.mark.parametrize(("kind", "size", "ok"), [("text/html; charset=utf-8", 5_000_000, True), ("image/webp", 10, False), ("text/plain", 2_000_000_000, False), ("application/xhtml+xml", 20, True)])
def test_valid_content(spark, kind, size, ok):
    assert one(spark, urls.valid_content(F.col("k"), F.lit(size)).alias("v"), k=kind).v.ok is ok


def test_quality_bounds(spark):
    for t in ("", "a", "Word. " * 500, None):
        c = F.col("t")
        r = spark.createDataFrame([(t,)], "t string").select(text.quality(F.size(text.words(c)), text.paragraph_count(c), text.sentence_count(c), text.readability(c)["flesch_reading_ease"], F.lit("A title that is long"), F.lit(None).cast("string"), text.unique_ratio(c)).alias("q")).first()
        assert 0 <= r.q <= 100


def test_fuzz_score():
    assert frontier.fuzz_score("abc", "abc") == 100
    assert frontier.fuzz_score("https://e.com/a", "https://e.com/b") == frontier.fuzz_score("https://e.com/b", "https://e.com/a") >= 85
    assert frontier.indel_ratio("kitten", "sitting") == 62
    assert frontier.indel_ratio("", "") == 100


def test_admit_known_and_batch(spark):
    new = spark.createDataFrame([("https://e.com/page1", 0, 1), ("https://e.com/page1/", 0, 2), ("https://e.com/page2", 0, 3), ("x", 0, 4)], "url string, depth int, created_at long")
    known = spark.createDataFrame([("https://e.com/page2",)], "u string").select(F.sha2("u", 256).alias("url_hash"))
    got = {r.url: r.status for r in frontier.admit(new, known).collect()}
    assert got == {"https://e.com/page1": "new", "https://e.com/page1/": "exact", "https://e.com/page2": "exact", "x": "error"}


def test_robots(spark):
    rows = spark.createDataFrame([("e", "https://e.com/a", "User-agent: *\nDisallow: /a"), ("e", "https://e.com/b", "User-agent: *\nDisallow: /a"), ("e", "https://e.com/a", None)], "domain string, url string, robots_txt string")
    assert [r.allowed for r in crawl.robots_allowed(rows).collect()] == [False, True, True]


def test_fetch(spark):
    def opener(url):
        if url.endswith("down"):
            raise OSError("down")
        return (200, "text/html; charset=latin-1", "é".encode("latin-1")) if url.endswith("ok") else (404, "text/html", b"")

    assert fetch.fetched("u/ok", opener)[4:6] == ("latin-1", "é")
    assert fetch.fetched("u/down", opener, 0)[-1] == "down"
    assert [r.error for r in fetch.fetch(spark.createDataFrame([("u/no",)], "url string"), opener).collect()] == ["HTTP 404"]


def test_cut_lengths(spark):
    r = one(spark, F.length(index.cut(F.col("a"), 200)).alias("n"), a="x" * 500)
    assert r.n == 203


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t, 1), ("a", t + datetime.timedelta(seconds=5), 2), ("b", t, 3)]
    spark.createDataFrame(rows, "domain string, ts timestamp, id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("domain string, ts timestamp, id long").parquet(str(tmp_path / "in"))
    q = jobs.first_seen(stream, "domain", "ts").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.domain for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    q = stream.writeStream.foreachBatch(jobs.upsert_into(str(tmp_path / "up"), "domain", "ts")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.domain, r.id) for r in spark.read.parquet(str(tmp_path / "up/v0")).collect()) == [("a", 2), ("b", 3)]
    q = jobs.politeness(stream, 10.0, None).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).option("path", str(tmp_path / "gate")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, r.ok) for r in spark.read.parquet(str(tmp_path / "gate")).collect()) == [(1, True), (2, False), (3, True)]


PAGE = (
    "<html><head><title>T</title></head><body><nav><a href='/a'>Home</a> <a href='/b'>About us</a></nav><script>var x = 1;</script>"
    + "<h1>A Heading</h1><p>" + "This is the text that was in the page and it is for all of us to be with. " * 4 + "</p><p>And then.</p><p>"
    + "There was a time that it is on the way to be from this and for that one here. " * 4 + "</p><ul><li><a href='/c'>More of this</a></li></ul><p>Copyright</p></body></html>"
)


def test_extraction(spark):
    d = spark.createDataFrame([(PAGE,), (None,), ("",), ("no markup",)], "h string").select(extract.blocks(F.col("h")).alias("b"))
    for rule in (extract.dense_text, extract.article_text, extract.stopword_text):
        full, null, empty, _ = [r.t for r in d.select(rule(F.col("b")).alias("t")).collect()]
        assert null == empty == ""
        assert "This is the text" in full and "There was a time" in full
        assert "Home" not in full and "More of this" not in full and "var x" not in full


def test_stopword_kinds():
    stops, good, short, bad = frozenset({"the"}), "the cat " * 40, "so", "cat dog " * 40
    n = lambda ts: [len(t.split()) for t in ts]
    for texts, want in (([good, short, good], [True, True, True]), ([bad, short, good], [False, False, True]), ([short], [False]), ([], [])):
        assert extract.kinds(texts, n(texts), [0] * len(texts), stops) == want
    near = "the cat " * 15
    assert extract.kinds([near, bad], n([near, bad]), [0, 0], stops) == [False, False]
    assert extract.kinds([bad, near, good], n([bad, near, good]), [0, 0, 0], stops) == [False, True, True]
    assert extract.kinds([good], n([good]), [60], stops) == [False]


def events(spark, rows):
    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(d, t + datetime.timedelta(seconds=s), i, w) for i, (d, s, w) in enumerate(rows)], "domain string, ts timestamp, id long, seconds double")


def test_concurrency(spark):
    e = events(spark, [("a", 0, 10.0), ("a", 1, 10.0), ("a", 2, 1.0), ("a", 10, 1.0), ("b", 0, None), ("a", 20, 900.0), ("a", 30, 900.0), ("a", 321, 1.0)])
    assert [(r.id, r.running) for r in crawl.over_concurrency(e).collect()] == [(2, 2)]


def test_sticky_and_balanced(spark):
    e = events(spark, [("a", 0, 1.0), ("b", 1, 1.0), ("a", 2, 1.0), ("a", 3599, 1.0), ("b", 3600, 1.0), ("a", 3601, 1.0)])
    assert [r.shard for r in crawl.load_balanced(e).orderBy("id").collect()] == [0, 1, 2, 0, 0, 1]
    assert [r.shard for r in crawl.sticky(e).orderBy("id").collect()] == [0, 1, 0, 0, 0, 1]
    assert crawl.rebalance(crawl.load_balanced(events(spark, []))).collect() == []


def run(df, tmp_path, name):
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).option("path", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / name)).collect()


def test_politeness_with_ttl_ends(spark, tmp_path):
    events(spark, [("a", 0, 1.0), ("a", 5, 1.0), ("a", 7200, 1.0), ("b", 0, 1.0)]).select("domain", "ts", "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("domain string, ts timestamp, id long").parquet(str(tmp_path / "in"))
    assert sorted((r.id, r.ok) for r in run(jobs.politeness(stream, 10.0), tmp_path, "gate")) == [(0, True), (1, False), (2, True), (3, True)]


def test_delay_queue_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = datetime.datetime(2024, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    rows = [(1, at(60), 1, at(0)), (2, at(61), 6, at(0)), (3, at(9000), 1, at(600)), (4, at(90), 2, at(30))]
    spark.createDataFrame(rows, "id long, ready_at timestamp, attempts int, ts timestamp").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("id long, ready_at timestamp, attempts int, ts timestamp").parquet(str(tmp_path / "q"))
    try:
        assert sorted(r.id for r in run(jobs.delay_queue(stream), tmp_path, "due")) == [1, 4]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_best_candidate_is_that_of_all_scores():
    import random

    from loomcrawl.operators import frontier

    r = random.Random(3)
    urls = ["", "/", "https://é.test/ü"] + [f"https://{r.choice(['shop', 'press'])}.test/" + "/".join("".join(r.choices("abcdé7", k=r.randint(1, 6))) for _ in range(r.randint(0, 3))) for _ in range(60)]
    for threshold in (0, 70, 85, 100):
        for url in urls:
            scores = [(frontier.fuzz_score(url, u), -k, u) for k, u in enumerate(urls) if u != url]
            n, _, u = max(scores)
            assert frontier.Candidates(urls).best(url, threshold) == ((u, n) if n >= threshold else None)


def test_fewer_scores_than_pairs(monkeypatch):
    from loomcrawl.operators import frontier

    done = []
    monkeypatch.setattr(frontier, "partial_ratio", lambda a, b, f=frontier.partial_ratio: done.append(1) or f(a, b))
    urls = [f"https://a.test/{k * 7919 % 100003:06d}/{'xyzuvw'[k % 6] * 9}" for k in range(100)]
    own = frontier.Candidates(urls)
    assert all(own.best(u, 85) for u in urls) and len(done) < 2000
