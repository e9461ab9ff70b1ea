"""Composites: what a page or document goes through as a whole, duplicate verdicts, domain records, analytics."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcrawl.functions import html, text, urls
from loomcrawl.functions.fixed import STOP_WORDS
from loomcrawl.operators import index

#: Least length of html and of extracted text; least length of a text that is analysed; their errors.
LEAST_LENGTH, LEAST_ANALYSED = 100, 50
TOO_SHORT, NO_TEXT = "Content too short or empty", "No meaningful content extracted"


def analysis(t: Column, title: Column, measures: dict[str, Column] | None = None) -> list[Column]:
    """The analysis of a text as named columns; all zero, empty or unknown for one of under LEAST_ANALYSED characters.

    Put t in a column of its own first: it's used several times. measures are text.measures(t, title) or columns of them.
    """
    m = text.measures(t, title) if measures is None else measures
    short = m["_short"] if "_short" in m else _short(t)
    words, sentences, paragraphs, language = (m[k] for k in ("_words", "_sentences", "_paragraphs", "_language"))
    ease = text.readability_of(words, sentences, m["_syllables"], m["_characters"])
    quality = text.quality(words, paragraphs, sentences, ease["flesch_reading_ease"], title, F.lit(""), m["_ratio"])
    values = {
        "character_count": (F.length(t).cast("long"), F.lit(0).cast("long")),
        "word_count": (words.cast("long"), F.lit(0).cast("long")),
        "sentence_count": (sentences.cast("long"), F.lit(0).cast("long")),
        "paragraph_count": (paragraphs.cast("long"), F.lit(0).cast("long")),
        **{k: (F.round(c, 6), F.lit(0.0)) for k, c in ease.items()},
        "reading_time_minutes": (F.round(words / F.lit(200.0), 6), F.lit(0.0)),
        "detected_language": (language, F.lit("unknown")),
        "language_confidence": (F.when(language == "unknown", 0.0).otherwise(0.8), F.lit(0.0)),
        "quality_score": (F.round(quality, 4), F.lit(0.0)),
        "content_type": (m["_type"], F.lit("unknown")),
    }
    return [F.when(short, none).otherwise(c).alias(k) for k, (c, none) in values.items()]


def _short(t: Column) -> Column:
    return (F.length(F.regexp_replace(t, "^\\s+|\\s+$", "")) < LEAST_ANALYSED) | t.isNull()


def analysed(d: DataFrame, t: str, title: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns keep of d and the analysis of its column t, each measure computed once."""
    m = text.measured(d.withColumn("_short", _short(F.col(t))), t, title)
    return m.select(*keep, *analysis(F.col(t), F.col(title), {k: F.col(k) for k in (*text.MEASURES, "_short")}))


def process_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as processed: success, error, the text's hash and analysis, counts of links by kind.

    A page or a text of under LEAST_LENGTH characters fails with its error, and has nulls for the rest.
    """
    d = pages.select("page_id", "url", F.length("html").alias("size"), html.plain_text(F.col("html")).alias("text"), html.title(F.col("html")).alias("title"))
    failed = F.when(F.coalesce("size", F.lit(0)) < LEAST_LENGTH, TOO_SHORT).when(F.coalesce(F.length("text"), F.lit(0)) < LEAST_LENGTH, NO_TEXT)
    kinds = index.links(pages).groupBy("page_id").agg(*[F.count_if(F.col("link_type") == k).alias(f"{k}_links") for k in ("internal", "external")])
    done = analysed(d.withColumn("error", failed), "text", "title", ("page_id", "url", "text", "error")).join(kinds, "page_id", "left")
    links = {f"{k}_links": F.coalesce(f"{k}_links", F.lit(0)).cast("long") for k in ("internal", "external")}
    own = ("character_count", "word_count", "quality_score", "detected_language", "content_type")
    ok = F.col("error").isNull()
    kept = {"content_hash": F.sha2("text", 256), **{c: F.col(c) for c in own}, **links, "links_count": links["internal_links"] + links["external_links"]}
    return done.select("page_id", "url", ok.alias("success"), "error", *[F.when(ok, c).alias(k) for k, c in kept.items()])


def merged(fetched: DataFrame, analysed: DataFrame, key: str) -> DataFrame:
    """Metadata of both, row by row: where both have a column the analysis' value holds, unless its row is missing."""
    there = analysed.withColumn("_there", F.lit(True))
    both = [c for c in analysed.columns if c != key and c in fetched.columns]
    renamed = there.select(key, "_there", *[F.col(c).alias(f"_{c}") if c in both else c for c in analysed.columns if c != key])
    rows = fetched.join(renamed, key, "left")
    return rows.select(*[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in both else c for c in fetched.columns], *[c for c in analysed.columns if c != key and c not in both])


def keywords(c: Column, most: int = index.MOST_KEYWORDS) -> Column:
    """A comma list as an array of trimmed words, the first `most`."""
    return F.slice(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda w: F.trim(w)), 1, most)


def index_document(parsed: DataFrame, now: Column | None = None) -> DataFrame:
    """Parsed content (url, final_url, structs content, metadata, original_fetch_data) as a document of the index."""
    m, c, f = (lambda k, s=s, none=None: F.coalesce(F.col(f"{s}.{k}"), none) if none is not None else F.col(f"{s}.{k}") for s in ("metadata", "content", "original_fetch_data"))
    now = F.current_timestamp() if now is None else now
    none, zero = F.lit(""), F.lit(0)
    return parsed.select(
        "url", F.coalesce("final_url", "url").alias("final_url"), F.lower(urls.netloc(F.col("url"))).alias("domain"),
        index.cut(F.trim(m("title", none=none)), index.MOST_TITLE).alias("title"), index.cut(c("text", none=none), index.MOST_CONTENT).alias("content"), c("content_hash", none=none).alias("content_hash"),
        index.cut(F.trim(m("description", none=none)), index.MOST_DESCRIPTION).alias("description"), F.slice(F.coalesce(m("keywords"), F.array().cast("array<string>")), 1, index.MOST_KEYWORDS).alias("keywords"),
        m("detected_language", none=F.lit("unknown")).alias("language"), m("content_type", none=F.lit("article")).alias("content_type"), m("quality_score", none=zero).alias("quality_score"),
        m("word_count", none=zero).alias("word_count"), m("reading_time_minutes", none=zero).alias("reading_time_minutes"), m("flesch_reading_ease", none=zero).alias("flesch_reading_ease"),
        *[m(k, none=zero).alias(k) for k in ("links_count", "internal_links", "external_links")],
        F.to_timestamp(f("fetched_at")).alias("crawled_at"), now.alias("indexed_at"), now.alias("last_updated"), F.lit("indexed").alias("status"),
        f("depth", none=zero).alias("crawl_depth"), c("content_length", none=zero).alias("content_length"), f("response_time", none=zero).alias("response_time"), f("status_code", none=F.lit(200)).alias("http_status"),
    )


def check_duplicates(new: DataFrame, known: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """Of each new (normalized_url): is_duplicate, match_type, existing_url_hash, similarity_score.

    known has url_hash; fuzzy has normalized_url, match_url, score (frontier.fuzzy_matches). An exact match wins.
    """
    d = new.withColumn("url_hash", urls.url_hash(F.col("normalized_url"))).join(known.select(F.col("url_hash").alias("known_hash")).distinct(), F.col("url_hash") == F.col("known_hash"), "left")
    exact = F.col("known_hash").isNotNull()
    if fuzzy is None:
        near, found, score = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("int")
    else:
        best = fuzzy.groupBy("normalized_url").agg(F.max_by("match_url", "score").alias("match_url"), F.max("score").alias("near_score"))
        d = d.join(best, "normalized_url", "left")
        near, found, score = F.col("match_url").isNotNull(), urls.url_hash(F.col("match_url")), F.col("near_score")
    kind = F.when(exact, "exact").when(near, "fuzzy").otherwise("none")
    return d.select(*new.columns, (kind != "none").alias("is_duplicate"), kind.alias("match_type"), F.when(exact, F.col("known_hash")).when(near, found).alias("existing_url_hash"), F.when(exact, 100).when(near, score).otherwise(0).cast("int").alias("similarity_score"))


def domain_records(domains: DataFrame, stats: DataFrame) -> DataFrame:
    """The stats (domain, requests, successes, avg_response, delay) of the asked domains; a zero record with delay 1 for unknown ones."""
    none = {"requests": 0, "successes": 0, "avg_response": 0.0, "delay": 1.0}
    return domains.join(stats, "domain", "left").select(*domains.columns, *[F.coalesce(k, F.lit(v)).cast("double" if isinstance(v, float) else "long").alias(k) for k, v in none.items()])


def analytics(docs: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Documents by value of several columns in one pass, the most frequent n of each: facet, key, n, rank."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("key")) for c in columns])).alias("p")
    counts = docs.select(pairs).select("p.facet", "p.key").where("key is not null").groupBy("facet", "key").agg(F.count("*").alias("n"))
    most = F.create_map(*[x for c, n in columns.items() for x in (F.lit(c), F.lit(n))])[F.col("facet")]
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "key")).cast("long")).where(F.col("rank") <= most)


def top_words(docs: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, word, n, rank of docs (doc_id, text): a document's most frequent words, the earlier first of equals.

    Each is counted in its own row. Rows that share a doc_id are one document; if there are any, words meet by doc_id.
    """
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        w = docs.select("doc_id", text.keyword_candidates(F.col("text")).alias("w"))
        rows = w.select("doc_id", F.posexplode("w").alias("pos", "word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
        top = rows.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "first", "word"))), 1, most).alias("k"))
        return top.select("doc_id", F.posexplode("k").alias("rank", "k")).select("doc_id", F.col("k.word").alias("word"), (-F.col("k.neg")).alias("n"), (F.col("rank") + 1).cast("long").alias("rank"))
    stop = frozenset(STOP_WORDS)

    def run(batches):
        for b in batches:
            places, words, ns, ranks = [], [], [], []
            for i in range(b.num_rows):
                for rank, (word, n) in enumerate(Counter(w for w in b.column(1)[i].as_py().split() if len(w) > 3 and w not in stop).most_common(most), 1):
                    places.append(i)
                    words.append(word)
                    ns.append(n)
                    ranks.append(rank)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places, pa.int64())), pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(ranks, pa.int64())], names=["doc_id", "word", "n", "rank"])

    spaced = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "\\P{L}+", " ")
    return docs.select("doc_id", spaced).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word string, n long, rank long")
