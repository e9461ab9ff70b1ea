"""The stored search index and the composites around pages, documents and domains."""

import datetime
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomcrawl.operators import index, service

DOCS = [
    (1, "Bread and salt", None, "How bread is baked with salt and flour", ["oven", "flour"], "b.test", "en", 40.0, "2024-02-01"),
    (2, "Flour", "all about flour", "Flour is milled from wheat. " * 40, ["wheat"], "b.test", "en", 70.0, "2024-02-02"),
    (3, None, None, None, None, "c.test", "de", 90.0, "2024-02-03"),
    (4, "Salt mines", None, "", ["bread salt"], "c.test", "de", 10.0, "2024-02-04"),
    (5, "", None, "slat and bread in raed order", [], "c.test", "en", 100.0, None),
]
SCHEMA = "id long, title string, description string, content string, keywords array<string>, domain string, language string, quality_score double, day string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, SCHEMA).withColumn("crawled_at", F.col("day").cast("timestamp"))
    return index.Index.write(docs, str(tmp_path_factory.mktemp("index") / "x"))


def ids(df):
    return [r.id for r in df.collect()]


def brute(terms, boosts):
    fields = {"title": 1, "description": 2, "content": 3, "keywords": 4}
    out = {}
    for f, boost in boosts.items():
        words = {d[0]: re.findall(r"[^\W\d_]+", (" ".join(d[fields[f]] or []) if f == "keywords" else d[fields[f]] or "").lower()) for d in DOCS}
        mean = sum(map(len, words.values())) / len(words)
        for i, w in words.items():
            if all(t in w for t in terms):
                score = 0
                for t in terms:
                    df = sum(t in x for x in words.values())
                    score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * w.count(t) / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
                out[i] = max(out.get(i, 0), boost * score)
    return out


@pytest.mark.parametrize("query", ["bread", "salt bread", "flour", "wheat", "oven flour", "nothing", "bread nothing"])
def test_scores(stored, query):
    r = index.SearchRequest(query)
    want = brute(query.split(), dict(r.fields))
    got = {x.id: x.score for x in stored.scores(r).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blank_query_and_filters(stored):
    assert sorted(ids(stored.hits(index.SearchRequest("")))) == [1, 2, 3, 4, 5]
    assert sorted(ids(stored.hits(index.SearchRequest("", filters={"domain": ["c.test"], "language": ["de"]}, min_quality=50)))) == [3]
    assert sorted(ids(stored.hits(index.SearchRequest("", crawled=("2024-02-02", "2024-02-03"))))) == [2, 3]
    assert sorted(ids(stored.hits(index.SearchRequest("", crawled=("2024-02-03", None))))) == [3, 4]
    assert ids(stored.search(index.SearchRequest("", sort="date", size=2))) == [4, 3]
    assert ids(stored.search(index.SearchRequest("", sort="quality", size=2, page=2))) == [2, 1]


def test_fuzzy(stored):
    assert sorted(ids(stored.hits(index.SearchRequest("salt", fuzzy=True)))) == [1, 4, 5]  # slat: neighbours exchanged
    assert sorted(ids(stored.hits(index.SearchRequest("bred", fuzzy=True)))) == [1, 4, 5]
    assert ids(stored.hits(index.SearchRequest("bred"))) == []


def test_distance(spark):
    def edits(a, b):
        """Breadth first over single edits, up to two."""
        def once(w):
            letters = "abc"
            yield from (w[:i] + w[i + 1 :] for i in range(len(w)))
            yield from (w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters)
            yield from (w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters)
            yield from (w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1))

        if a == b:
            return 0
        first = set(once(b))
        return 1 if a in first else 2 if any(a in set(once(x)) for x in first) else 3

    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abc", repeat=n)] + ["".join(random.Random(1).choices("abc", k=5)) for _ in range(20)]
    for term in ("ab", "abca", "aabc"):
        rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", index.distance(F.col("w"), term).alias("d")).collect()
        assert all(min(r.d, 3) == edits(r.w, term) for r in rows)


def test_response(stored):
    rows = stored.respond(index.SearchRequest("flour", size=1), ("id", "content")).collect()
    assert [(r.rank, r.id, r.total_hits, r.total_pages) for r in rows] == [(1, 2, 2, 2)] and len(rows[0].content) == 503
    rows = stored.respond(index.SearchRequest("flour", size=1, page=2), ("id", "content")).collect()
    assert [(r.rank, r.id) for r in rows] == [(2, 1)]
    assert stored.by_hash("0").count() == 0 and stored.stats().first().docs == 5


def test_parameters():
    r = index.SearchRequest.parsed({"q": " bread ", "domains": "a.test, b.test,", "languages": "", "min_quality": "50", "date_from": "2024-01-01", "page": "0", "size": "1000", "fuzzy": "true"})
    assert (r.query, r.filters, r.min_quality, r.crawled, r.page, r.size, r.fuzzy) == ("bread", {"domain": ["a.test", "b.test"]}, 50.0, ("2024-01-01", None), 1, 100, True)
    assert index.SearchRequest.parsed({}) == index.SearchRequest()


def test_process_pages(spark):
    body = "Roses need sun and water. " * 20
    pages = [(1, "https://g.test/a", f'<title>Roses</title><p>{body}</p><a href="/b">b</a><a href="https://o.test/x">o</a>'), (2, "https://g.test/b", "<p>short"), (3, "https://g.test/c", f"<script>{body}</script><p>x</p>"), (4, "https://g.test/d", None)]
    got = {r.page_id: r for r in service.process_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k].error for k in (1, 2, 3, 4)] == [None, service.TOO_SHORT, service.NO_TEXT, service.TOO_SHORT]
    assert (got[1].success, got[1].internal_links, got[1].external_links, got[1].links_count) == (True, 1, 1, 2) and len(got[1].content_hash) == 64
    assert got[2].success is False and got[2].content_hash is None and got[2].quality_score is None


def test_analysis_of_short_texts(spark):
    rows = spark.createDataFrame([(" " * 60,), ("x" * 49,), (None,), ("word " * 10,)], "t string").select(*service.analysis(F.col("t"), F.lit(""))).collect()
    assert [r.word_count for r in rows] == [0, 0, 0, 0] and {r.content_type for r in rows} == {"unknown"}
    r = spark.createDataFrame([("The word and the other word are here for all of you. " * 3,)], "t string").select(*service.analysis(F.col("t"), F.lit(""))).first()
    assert (r.word_count, r.sentence_count, r.detected_language, r.language_confidence) == (36, 3, "en", 0.8)


def test_merge_and_keywords(spark):
    fetched = spark.createDataFrame([(1, "a, b", "text/html", 9), (2, "c", "text/html", 3)], "id long, keywords string, content_type string, size int")
    analysed = spark.createDataFrame([(1, "z", None)], "id long, keywords string, content_type string").withColumn("quality", F.lit(5))
    got = {r.id: r for r in service.merged(fetched, analysed, "id").collect()}
    assert tuple(got[1]) == (1, "z", None, 9, 5) and tuple(got[2]) == (2, "c", "text/html", 3, None)
    r = spark.createDataFrame([(" a ,b, c d ", None)], "k string, n string").select(service.keywords(F.col("k"), 2).alias("k"), service.keywords(F.col("n")).alias("n")).first()
    assert r.k == ["a", "b"] and r.n == [""]


def test_index_document(spark):
    schema = """url string, final_url string, content struct<text string, content_hash string, content_length int>, metadata struct<title string, description string, keywords array<string>, detected_language string, content_type string, quality_score double, word_count int, reading_time_minutes double, flesch_reading_ease double, links_count int, internal_links int, external_links int>,
    original_fetch_data struct<fetched_at string, depth int, response_time double, status_code int>"""
    full = ("https://Shop.Test/x", None, ("t" * 1_000_500, "h", 7), (" T" * 300, "d" * 600, [str(i) for i in range(30)], "fr", "news", 12.5, 3, 0.1, 50.0, 4, 3, 1), ("2024-05-06T07:08:09", 2, 0.5, 203))
    bare = ("https://a.test/", "https://b.test/", (None, None, None), (None,) * 12, (None,) * 4)
    a, b = service.index_document(spark.createDataFrame([full, bare], schema)).collect()
    assert len(a) == 25 and (len(a.content), len(a.title), len(a.description), len(a.keywords)) == (1_000_003, 203, 503, 20)
    assert (a.domain, a.final_url, a.crawl_depth, a.http_status, a.status) == ("shop.test", "https://Shop.Test/x", 2, 203, "indexed") and a.crawled_at.replace(tzinfo=None) == datetime.datetime(2024, 5, 6, 7, 8, 9)
    assert (b.title, b.content, b.keywords, b.language, b.content_type, b.quality_score, b.http_status, b.crawled_at) == ("", "", [], "unknown", "article", 0, 200, None)


def test_duplicates(spark):
    new = spark.createDataFrame([(u,) for u in ("https://a.test/x", "https://a.test/xy", "https://a.test/zzz")], "normalized_url string")
    known = spark.createDataFrame([("https://a.test/x",)], "u string").select(F.sha2("u", 256).alias("url_hash"))
    near = spark.createDataFrame([("https://a.test/x", "https://a.test/xy", 97), ("https://a.test/xy", "https://a.test/x", 97)], "normalized_url string, match_url string, score int")
    got = {r.normalized_url[-3:]: (r.is_duplicate, r.match_type, r.similarity_score) for r in service.check_duplicates(new, known, near).collect()}
    assert got == {"t/x": (True, "exact", 100), "/xy": (True, "fuzzy", 97), "zzz": (False, "none", 0)}
    assert {r.match_type for r in service.check_duplicates(new, known).collect()} == {"exact", "none"}


def test_domain_records(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "domain string")
    stats = spark.createDataFrame([("a", 3, 2, 0.5, 4.0)], "domain string, requests long, successes long, avg_response double, delay double")
    assert sorted(map(tuple, service.domain_records(asked, stats).collect())) == [("a", 3, 2, 0.5, 4.0), ("b", 0, 0, 0.0, 1.0)]


def test_measures_are_computed_once(spark, tmp_path):
    d = spark.createDataFrame([("The word and the other word are here for all of you. " * 3,), (" ",), (None,)], "t string").withColumn("title", F.lit("A word of you"))
    d.write.parquet(path := str(tmp_path / "measures"))
    got = service.analysed(spark.read.parquet(path), "t", "title", ("t",))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    for once in ("[aeiouy", "[^\\p{L}\\p{N}]", "[^ \\t", "^\\s+"):
        assert plan.count(once) == 1, once
    want = spark.read.parquet(path).select("t", *service.analysis(F.col("t"), F.col("title")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_postings_without_shuffle_and_of_repeated_ids(spark, tmp_path):
    rows = [(1, "b a B", "a"), (2, None, "ſ É2é x_y"), (3, "", None)]
    docs = spark.createDataFrame(rows, "id long, title string, content string")
    one = index.postings(docs, ["title", "content"])
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    want = [("content", 1, 1, "a", 1), ("title", 1, 3, "a", 1), ("title", 1, 3, "b", 2)] + [("content", 2, 5, t, n) for t, n in (("x", 1), ("y", 1), ("é", 2), ("ſ", 1))]
    assert sorted(map(tuple, one.collect())) == sorted(want)
    twice = index.postings(docs.unionByName(docs), ["title", "content"])
    assert sorted(map(tuple, twice.collect())) == sorted((*r[:4], 2 * r[4]) for r in want)
    stored = index.Index.write(docs, str(tmp_path / "i"))
    assert {r.field: (r.n, r.avgdl) for r in stored.table("fields").collect()} == {"title": (3, 1.0), "content": (3, 2.0)}
    empty = index.Index.write(docs.limit(0), str(tmp_path / "e"))
    assert empty.table("fields").count() == 2 and empty.scores(index.SearchRequest("a")).count() == 0


def test_documents_alone_answer_by_hash(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "id long, content string")
    i = index.Index.documents(docs, str(tmp_path / "i"))
    assert [p.name for p in tmp_path.joinpath("i").iterdir()] == ["docs"]
    assert ids(i.by_hash(docs.select(F.sha2("content", 256)).first()[0])) == [1]
    assert i.complete().stats().first().postings == 2


def test_top_words(spark):
    docs = spark.createDataFrame([(1, "beta Alpha alpha beta gamma with this abc"), (None, None), (2, "Ünder-ünder x9long")], "doc_id long, text string")
    got = service.top_words(docs, 2)
    assert sorted(map(tuple, got.collect())) == [(1, "alpha", 2, 2), (1, "beta", 2, 1), (2, "long", 1, 2), (2, "ünder", 2, 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    again = service.top_words(docs.unionByName(docs.where("doc_id = 1")), 2)
    assert sorted(map(tuple, again.collect())) == [(1, "alpha", 4, 2), (1, "beta", 4, 1), (2, "long", 1, 2), (2, "ünder", 2, 1)]
