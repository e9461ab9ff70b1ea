"""Index shaping and search: content documents, link edges, deduplication, postings, BM25, facets, analytics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcrawl.functions import html, text, urls

K1, B = 1.2, 0.75
#: Buckets of postings, words a fuzzy term may stand for, characters of a result's content, results of a page.
BUCKETS, EXPANSIONS, MOST_SHOWN, MOST_SIZE = 64, 50, 500, 100
MOST_CONTENT, MOST_TITLE, MOST_DESCRIPTION, MOST_KEYWORDS = 1_000_000, 200, 500, 20


def cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def content_documents(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as index documents."""
    d = pages.select("page_id", "url", "html").withColumn("content", html.plain_text(F.col("html"))).withColumn("page_title", html.title(F.col("html")))
    m = text.measured(d, "content", "page_title")
    words = F.col("_words")
    ease = text.readability_of(words, F.col("_sentences"), F.col("_syllables"), F.col("_characters"))["flesch_reading_ease"]
    quality = text.quality(words, F.col("_paragraphs"), F.col("_sentences"), F.col("_ease"), F.col("page_title"), F.lit(""), F.col("_ratio"))
    return m.withColumn("_ease", ease).select("page_id", "url", urls.domain(F.col("url")).alias("domain"), cut(F.col("page_title"), MOST_TITLE).alias("title"), cut(F.col("content"), MOST_CONTENT).alias("content"), F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("content_length"), words.cast("long").alias("word_count"), html.count_links(F.col("html")).cast("long").alias("links_count"), F.col("_type").alias("content_type"), F.coalesce(F.nullif(html.lang(F.col("html")), F.lit("")), F.lit("unknown")).alias("language"), F.round(quality, 4).alias("quality_score"))


def links(pages: DataFrame, depth: int = 0) -> DataFrame:
    """One row per distinct link of a page, first place wins: target, anchor, internal or external, depth one deeper."""
    pairs = F.arrays_zip(html.hrefs(F.col("html")).alias("href"), html.anchors(F.col("html")).alias("anchor"))
    rows = pages.select("page_id", "url", F.posexplode(pairs).alias("pos", "l")).select("page_id", "url", "pos", F.col("l.href").alias("href"), F.left(F.trim(F.col("l.anchor")), F.lit(200)).alias("anchor_text"))
    d = rows.withColumn("target_url", urls.link_target(F.col("href"), F.col("url"))).where(F.col("target_url").isNotNull())
    first = d.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "target_url").orderBy("pos"))).where("n = 1")
    kind = F.when(urls.registered_domain(F.col("target_url")) == urls.registered_domain(F.col("url")), "internal").otherwise("external")
    return first.select("page_id", F.col("url").alias("source_url"), "target_url", "anchor_text", kind.alias("link_type"), F.lit(depth + 1).alias("crawl_depth"), urls.domain(F.col("url")).alias("domain"), urls.domain(F.col("target_url")).alias("target_domain"), F.md5(F.concat(F.col("url"), F.lit("-"), F.col("target_url"))).alias("link_id"))


def content_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): the first row of a text is indexed, others are deduplicated and name it.

    The first is found by an aggregate with map-side combine and joined back, so a text that a third of all rows
    share is no single window partition.
    """
    d = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = d.groupBy("content_hash").agg(F.min("doc_id").alias("original_id"))
    return d.join(first, "content_hash").select("doc_id", "content_hash", "original_id", F.when(F.col("doc_id") == F.col("original_id"), "indexed").otherwise("deduplicated").alias("action"))


def domain_rollup(docs: DataFrame) -> DataFrame:
    return docs.groupBy("domain").agg(F.count("*").alias("pages_count"), F.round(F.avg("quality_score"), 4).alias("avg_quality"), F.sum("content_length").alias("total_length"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.array_join(F.array_sort(F.collect_set("content_type")), ",").alias("content_types"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Last write per key wins."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n = 1").drop("n")


@dataclass
class SearchRequest:
    query: str = ""
    filters: dict[str, list[str]] = field(default_factory=dict)
    min_quality: float | None = None
    crawled: tuple[str | None, str | None] = (None, None)
    sort: str = "relevance"
    page: int = 1
    size: int = 10
    fuzzy: bool = False
    fields: tuple[tuple[str, float], ...] = (("title", 3.0), ("description", 2.0), ("content", 1.0), ("keywords", 1.5))

    @staticmethod
    def parsed(given: dict[str, str]) -> SearchRequest:
        """A request from string parameters: comma lists become filters, page and size are at least 1, size at most MOST_SIZE."""
        several = {"domains": "domain", "languages": "language", "content_types": "content_type"}
        filters = {column: values for name, column in several.items() if (values := [v.strip() for v in given.get(name, "").split(",") if v.strip()])}
        least = given.get("min_quality", "").strip()
        return SearchRequest(
            given.get("q", "").strip(), filters, float(least) if least else None, (given.get("date_from") or None, given.get("date_to") or None),
            given.get("sort_by", "relevance"), max(1, int(given.get("page", 1))), min(MOST_SIZE, max(1, int(given.get("size", 10)))), given.get("fuzzy", "").lower() in ("1", "true", "yes"),
        )


def terms_of(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(r"[^\W\d_]+", query.lower())))


def edits(term: str) -> int:
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


#: Posting rows that a task holds before it hands them on.
HELD = 100_000


def postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, id, dl, term, tf: the inverted index. A document's terms are counted in its own row; only documents that share an id are merged."""
    spaced = [F.regexp_replace(F.lower(F.coalesce(_searched(docs, f), F.lit(""))), "\\P{L}+", " ").alias(f"f{k}") for k, f in enumerate(fields)]
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            places, names, dls, terms, tfs = [], [], [], [], []

            def told():
                return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column(0).take(pa.array(places, pa.int64())), pa.array(dls, pa.int32()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=["field", "id", "dl", "term", "tf"])

            for i in range(b.num_rows):
                for f, column in zip(fields, b.columns[1:], strict=True):
                    words = column[i].as_py().split()
                    found = Counter(words)
                    places += [i] * len(found)
                    names += [f] * len(found)
                    dls += [len(words)] * len(found)
                    terms += found.keys()
                    tfs += found.values()
                if len(places) >= HELD:
                    yield told()
                    places, names, dls, terms, tfs = [], [], [], [], []
            if places:
                yield told()

    rows = docs.select("id", *spaced).mapInArrow(run, f"field string, id {id_type}, dl int, term string, tf long")
    if docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("field", "id", "dl", "term").agg(F.sum("tf").alias("tf"))


def _searched(docs: DataFrame, name: str) -> Column:
    """A field as text; an array's values in a row."""
    return F.array_join(name, " ") if docs.schema[name].dataType.typeName() == "array" else F.col(name)


def transposed(word: str) -> list[str]:
    """The word with each two neighbours exchanged."""
    return list(dict.fromkeys(word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1) if word[i] != word[i + 1]))


def distance(x: Column, term: str) -> Column:
    """Edits from a word to the term, exact up to two: insertions, deletions, changes, exchanges of neighbours."""
    once = transposed(term)
    twice = sorted({w for t in once for w in transposed(t)} - {term})
    best = [F.levenshtein(x, F.lit(term)), *[F.levenshtein(x, F.lit(t)) + 1 for t in once]]
    # An exchange of neighbours that an insertion or deletion brought together: seen from the word's side.
    turned = lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.lit(1)), F.substr(x, i, F.lit(1)), F.substr(x, i + 2))
    best.append(F.when(F.length(x) > 1, F.array_min(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.levenshtein(turned(i), F.lit(term)))) + 1).otherwise(len(term) + 2))
    if twice:
        best.append(F.when(x.isin(*twice), 2).otherwise(len(term) + 2))
    return F.least(*best)


@dataclass
class Index:
    """A written index: postings by a bucket of the term's hash, the documents, each field's size and the vocabulary.

    A request reads the postings of its terms' buckets alone, whose statistics hold the terms next to each other.
    """

    spark: SparkSession
    path: str

    @staticmethod
    def write(docs: DataFrame, path: str, fields: tuple[str, ...] = ("title", "description", "content", "keywords")) -> Index:
        """Writes docs (id and others) and their index below path."""
        return Index.documents(docs, path).complete(fields)

    @staticmethod
    def documents(docs: DataFrame, path: str) -> Index:
        """The documents alone: enough for by_hash."""
        docs.write.parquet(f"{path}/docs")
        return Index(docs.sparkSession, path)

    def complete(self, fields: tuple[str, ...] = ("title", "description", "content", "keywords")) -> Index:
        """Writes the rest of an index that has its documents only.

        Files hold a bucket's postings or part of them: a bucket that is large is dealt out by size.
        """
        stored = self.table("docs")
        own = [f for f in fields if f in stored.columns]
        rows = postings(stored, own).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "field", "id").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        n = stored.count()
        sums = {r.field: r.s for r in self.table("postings").groupBy("field").agg(F.sum("tf").alias("s")).collect()}
        self.spark.createDataFrame([(n, f, sums.get(f, 0) / n if n else None) for f in own], "n long, field string, avgdl double").coalesce(1).write.parquet(f"{self.path}/fields")
        self.table("postings").select("term").distinct().write.parquet(f"{self.path}/terms")
        return self

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name == "postings":  # without postings there are no files to tell
            reader = reader.schema(f"field string, id {self.table('docs').schema['id'].dataType.simpleString()}, dl int, term string, tf long, bucket int")
        return reader.parquet(f"{self.path}/{name}")

    def expanded(self, term: str, fuzzy: bool) -> list[str]:
        """The words that stand for a term: with fuzzy those within its edits, the nearest EXPANSIONS."""
        if not fuzzy or not edits(term):
            return [term]
        # A word whose length is further from the term's needs more edits.
        near = self.table("terms").where(F.length("term").between(len(term) - edits(term), len(term) + edits(term))).withColumn("d", distance(F.col("term"), term)).where(F.col("d") <= edits(term))
        return [r.term for r in near.orderBy("d", "term").limit(EXPANSIONS).collect()]

    def scores(self, request: SearchRequest) -> DataFrame:
        """id, score of the documents one of whose fields holds all terms: the best field's boosted BM25 sum."""
        terms = terms_of(request.query)
        if not terms:
            return self.table("docs").select("id", F.lit(1.0).alias("score"))
        words = [self.expanded(t, request.fuzzy) for t in terms]
        every = sorted({w for own in words for w in own})
        buckets = [r.b for r in self.spark.createDataFrame([(w,) for w in every], "w string").select(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()] if every else []
        boosts = dict(request.fields)
        rows = self.table("postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(every) & F.col("field").isin(*boosts)) if every else self.table("postings").where("false")
        own = lambda k: F.sum(F.when(F.col("term").isin(words[k]), F.col("tf"))) if words[k] else F.lit(None).cast("long")
        found = rows.groupBy("field", "id").agg(F.first("dl").alias("dl"), *[own(k).alias(f"tf{k}") for k in range(len(terms))])
        df = found.groupBy("field").agg(*[F.count(f"tf{k}").alias(f"df{k}") for k in range(len(terms))])
        hit = found.where(" and ".join(f"tf{k} is not null" for k in range(len(terms)))).join(F.broadcast(df), "field").join(F.broadcast(self.table("fields")), "field")
        total = F.lit(0.0)
        for k in range(len(terms)):
            idf = F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
            total = total + idf * F.col(f"tf{k}") / (F.col(f"tf{k}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        boost = F.create_map(*[x for f, b in boosts.items() for x in (F.lit(f), F.lit(b))])[F.col("field")]
        return hit.groupBy("id").agg(F.max(boost * total).alias("score"))

    def hits(self, request: SearchRequest) -> DataFrame:
        """Documents that match, with score: statistics are the whole corpus's, filters don't change them."""
        return filtered(self.table("docs"), request).join(self.scores(request), "id")

    def search(self, request: SearchRequest) -> DataFrame:
        """A page of hits."""
        order = {"date": F.col("crawled_at").desc() if request.sort == "date" else None, "quality": F.col("quality_score").desc()}.get(request.sort, F.col("score").desc())
        return self.hits(request).orderBy(order, "id").offset((request.page - 1) * request.size).limit(request.size)

    def respond(self, request: SearchRequest, columns: tuple[str, ...]) -> DataFrame:
        """The page as a caller gets it: rank, columns (content cut for display), score, total_hits, total_pages."""
        found = self.search(request)
        order = {"date": F.col("crawled_at").desc() if request.sort == "date" else None, "quality": F.col("quality_score").desc()}.get(request.sort, F.col("score").desc())
        total = self.hits(request).agg(F.count("*").alias("total_hits"))
        shown = [cut(F.col(c), MOST_SHOWN).alias(c) if c == "content" else F.col(c) for c in columns]
        ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(order, "id")) + (request.page - 1) * request.size)  # one page's rows
        pages = F.ceil(F.col("total_hits") / request.size).cast("long").alias("total_pages")
        return ranked.crossJoin(F.broadcast(total)).select(F.col("rank").cast("long").alias("rank"), *shown, "score", "total_hits", pages)

    def by_hash(self, content_hash: str) -> DataFrame:
        """The documents with this content."""
        return self.table("docs").where(F.sha2("content", 256) == content_hash)

    def stats(self) -> DataFrame:
        """documents, terms, postings, bytes of the index's files."""
        count = lambda name: self.table(name).agg(F.count("*").alias(name))
        size = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path).agg(F.sum("length").alias("bytes"))
        return count("docs").crossJoin(count("terms")).crossJoin(count("postings")).crossJoin(size)


def filtered(docs: DataFrame, request: SearchRequest) -> DataFrame:
    for name, values in request.filters.items():
        docs = docs.where(F.col(name).isin(*values))
    lo, hi = request.crawled
    if lo is not None:
        docs = docs.where(F.col("crawled_at") >= F.lit(lo).cast("timestamp"))
    if hi is not None:
        docs = docs.where(F.col("crawled_at") <= F.lit(hi).cast("timestamp"))
    return docs if request.min_quality is None else docs.where(F.col("quality_score") >= request.min_quality)


def facet(found: DataFrame, name: str, n: int) -> DataFrame:
    return found.groupBy(F.col(name).alias("key")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "key").limit(n)


def quality_ranges(found: DataFrame) -> DataFrame:
    """Counts of [0,25) low, [25,50) medium, [50,75) good, [75,100) excellent; empty ones too, 100 in none."""
    q = F.col("quality_score")
    label = F.when((q >= 0) & (q < 25), "low").when((q >= 25) & (q < 50), "medium").when((q >= 50) & (q < 75), "good").when((q >= 75) & (q < 100), "excellent")
    count = lambda s: F.count_if(label == s)
    return found.agg(F.map_from_arrays(F.array(*map(F.lit, ("low", "medium", "good", "excellent"))), F.array(*map(count, ("low", "medium", "good", "excellent")))).alias("m")).select(F.explode("m").alias("key", "n"))


def inbound(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Of every linked URL: links, sources (pages), the first anchor text, and whether docs (url) has it.

    Links are counted before the join, so a URL that much of the corpus links to is one row in it.
    """
    counts = links.groupBy("target_url").agg(F.count("*").alias("links"), F.countDistinct("source_url").alias("sources"), F.min("anchor_text").alias("anchor_text"))
    have = docs.select(F.col("url").alias("target_url")).distinct().withColumn("_have", F.lit(True))
    return counts.join(have, "target_url", "left").withColumn("indexed", F.coalesce("_have", F.lit(False))).drop("_have")


def create_index(spark: SparkSession, name: str, schema: str, key: str, buckets: int = BUCKETS) -> bool:
    """Makes the table `name` (DDL columns, bucketed by key) unless it's there; tells if it was made."""
    if spark.catalog.tableExists(name):
        return False
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS")
    return True


def suggest(docs: DataFrame, prefix: str, n: int = 5) -> DataFrame:
    return docs.where(F.lower(F.col("title")).startswith(prefix.lower())).select("title").distinct().orderBy("title").limit(n)
