"""URL admission: normalise, deduplicate exactly and (optionally) fuzzily, prioritise, queue."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcrawl.functions import urls

FUZZY_SCORE, FUZZY_CANDIDATES = 85, 100


def admit(new: DataFrame, known: DataFrame | None = None, source: str = "seed") -> DataFrame:
    """new(url, depth, created_at) labelled: error (no canonical form), exact (known or earlier in the batch), new.

    A URL's first row by (created_at, url) wins; known has url_hash. Rows that name a source keep it. Spark prunes the anti-join by its runtime filter.
    """
    d = new.withColumn("normalized_url", urls.normalize(F.col("url"))).withColumn("url_hash", urls.url_hash(F.col("normalized_url"))).withColumn("domain", urls.domain(F.col("normalized_url")))
    d = d.withColumn("priority", urls.priority(F.col("normalized_url"), F.col("depth")))
    d = d if "source" in new.columns else d.withColumn("source", F.lit(source))
    first = F.row_number().over(Window.partitionBy("url_hash").orderBy("created_at", "url"))
    bad = d.where(F.col("normalized_url").isNull()).withColumn("status", F.lit("error"))
    good = d.where(F.col("normalized_url").isNotNull()).withColumn("n", first)
    if known is not None:
        good = good.join(known.select(F.col("url_hash").alias("h")).distinct(), F.col("url_hash") == F.col("h"), "left")
        seen = (F.col("n") > 1) | F.col("h").isNotNull()
    else:
        seen = F.col("n") > 1
    return good.withColumn("status", F.when(seen, "exact").otherwise("new")).drop("n", "h").unionByName(bad)


def from_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """URLs of several sources, each row with the name of its own."""
    rows = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return rows


def queued(queue: DataFrame, known: DataFrame) -> DataFrame:
    """The queue's waiting rows (url_id, status, scheduled_at) with their URLs (url_id, ...); rows without a URL go."""
    return queue.where("status = 'pending'").drop("status").join(known, "url_id")


def dedup_stats(labelled: DataFrame) -> DataFrame:
    """Admitted rows, and how many different URLs and fuzzy forms they have."""
    good = labelled.where("normalized_url is not null").select("url_hash", urls.fuzzy_hash(F.col("normalized_url")).alias("fuzzy_hash"), "status")
    return good.agg(F.count("*").alias("rows"), F.countDistinct("url_hash").alias("exact_hashes"), F.countDistinct("fuzzy_hash").alias("fuzzy_hashes"), F.count_if(F.col("status") == "new").alias("stored"))


def admission_counts(labelled: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return labelled.agg(F.count("*").alias("received"), F.count_if(F.col("status") != "error").alias("normalized"), count("exact"), count("new"), count("error"))


def priority_queue(admitted: DataFrame, n: int) -> DataFrame:
    return admitted.where(F.col("status") == "new").orderBy(F.col("priority").desc(), "created_at", "url_hash").limit(n)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def indel_ratio(a: str, b: str) -> int:
    """100 * 2 * (longest common subsequence) / (length of both), rounded."""
    return round(200 * common_length(a, b) / (len(a) + len(b))) if a or b else 100


def partial_ratio(a: str, b: str) -> int:
    short, long = sorted((a, b), key=len)
    return max((indel_ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1)), default=100) if short else int(not long) * 100


def _tokens(s: str) -> str:
    return " ".join(sorted(re.findall(r"\w+", s.lower())))


def fuzz_score(a: str, b: str) -> int:
    """The greatest of plain, token-sorted and partial ratio."""
    return max(indel_ratio(a, b), indel_ratio(_tokens(a), _tokens(b)), partial_ratio(a, b))


def _counts(s: str) -> np.ndarray:
    """A string's characters by the last byte of their code point."""
    return np.bincount(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) & 255, minlength=256).astype(np.int16)


class Candidates:
    """A domain's known URLs, newest first.

    Two strings have no longer subsequence in common than characters, which bounds each ratio: those that can't beat
    what is found aren't computed.
    """

    def __init__(self, urls: list[str]):
        self.urls, self.tokens = urls, [_tokens(u) for u in urls]
        self.counts, self.token_counts = (np.stack([_counts(x) for x in own]) for own in (self.urls, self.tokens))
        self.lengths, self.token_lengths = (np.array([len(x) for x in own], np.int64) for own in (self.urls, self.tokens))

    def best(self, url: str, threshold: int) -> tuple[str, int] | None:
        """The first of the URLs with the greatest fuzz_score, if that is threshold or more; url itself isn't one."""
        tokens, n = _tokens(url), len(url)
        common = np.minimum(self.counts, _counts(url)).sum(axis=1, dtype=np.int64)
        token_common = np.minimum(self.token_counts, _counts(tokens)).sum(axis=1, dtype=np.int64)
        shorter = np.minimum(self.lengths, n)
        plain = np.rint(200 * common / np.maximum(self.lengths + n, 1))
        sorted_ = np.rint(200 * token_common / np.maximum(self.token_lengths + len(tokens), 1))
        part = np.rint(100 * common / np.maximum(shorter, 1))
        empty = (shorter == 0) | ((self.token_lengths == 0) & (not tokens))  # these count as equal or as nothing
        most = np.where(empty, 100, np.maximum(np.maximum(plain, sorted_), part))
        found, least = None, threshold - 1
        for i in np.flatnonzero(most > least).tolist():
            other = self.urls[i]
            if most[i] <= least or other == url:
                continue
            if empty[i]:
                score = fuzz_score(url, other)
            else:
                score = max(indel_ratio(url, other) if plain[i] > least else 0, indel_ratio(tokens, self.tokens[i]) if sorted_[i] > least else 0)
                # Nor has any part of the longer one more in common with the shorter than the whole.
                if part[i] > least and round(100 * common_length(url, other) / int(shorter[i])) > max(least, score):
                    score = max(score, partial_ratio(url, other))
            if score > least:
                found, least = (other, score), score
        return found


def fuzzy_matches(new: DataFrame, known: DataFrame, threshold: int = FUZZY_SCORE, newest: int = FUZZY_CANDIDATES) -> DataFrame:
    """Best match (first of equals, newest first) of each new(url, domain) among the newest known ones of its domain."""
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("created_at").desc(), "normalized_url"))
    ranked = known.select("domain", "normalized_url", "created_at").withColumn("rank", rank).where((F.col("rank") <= newest) & F.col("normalized_url").isNotNull())
    candidates = ranked.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("rank", "normalized_url")))["normalized_url"].alias("urls"))
    asked = new.select("domain", "normalized_url").where("normalized_url is not null").distinct().join(candidates, "domain").select("domain", "normalized_url", "urls")

    def run(batches):
        domain, own = None, None
        for b in batches:
            rows = []
            for i, (d, url) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if own is None or d != domain:  # the join leaves a domain's rows next to each other
                    domain, own = d, Candidates(b.column(2)[i].as_py())
                if hit := own.best(url, threshold):
                    rows.append((d, url, *hit))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int32())], names=["domain", "normalized_url", "match_url", "score"])

    return asked.mapInArrow(run, "domain string, normalized_url string, match_url string, score int")
