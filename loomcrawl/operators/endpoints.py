"""What a search service answers, a function for each endpoint; no web server is part of it."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import astuple, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row

from loomcrawl.operators import index, service

#: Seconds an answer stays, sizes of the listings.
STAYS, MOST_FACETS, MOST_DOMAINS, MOST_VALUES = 300, 10, 50, 20


@dataclass
class Cache:
    """Answers (a page's rows each) by request, for STAYS seconds, the last `most` of them."""

    most: int = 1000
    clock: Callable[[], float] = time.monotonic
    kept: OrderedDict[Any, tuple[float, list[Row]]] = field(default_factory=OrderedDict)

    def get(self, key: Any, make: Callable[[], list[Row]]) -> list[Row]:
        now = self.clock()
        if key in self.kept and now - self.kept[key][0] < STAYS:
            self.kept.move_to_end(key)
            return self.kept[key][1]
        rows = make()
        self.kept[key] = (now, rows)
        self.kept.move_to_end(key)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return rows


@dataclass
class Endpoints:
    """Over a written index whose documents have the named columns for domain, language and type."""

    index: index.Index
    shown: tuple[str, ...]
    facets: tuple[str, ...] = ("domain", "language", "content_type")
    cache: Cache = field(default_factory=Cache)

    def health(self) -> DataFrame:
        return self.index.spark.createDataFrame([("healthy",)], "status string")

    def search(self, given: dict[str, str]) -> list[Row]:
        """The page of a request given as strings; whether facets are asked for makes no difference to it."""
        r = index.SearchRequest.parsed(given)
        return self.cache.get(repr(astuple(r)), lambda: self.index.respond(r, self.shown).collect())

    def search_facets(self, given: dict[str, str]) -> DataFrame:
        """facet, key, n, rank of all of a request's hits."""
        return service.analytics(self.index.hits(index.SearchRequest.parsed(given)), dict.fromkeys(self.facets, MOST_FACETS))

    def suggest(self, prefix: str, n: int = 5) -> DataFrame:
        return index.suggest(self.index.table("docs"), prefix, n)

    def analytics(self) -> DataFrame:
        return service.analytics(self.index.table("docs"), dict.fromkeys(self.facets, MOST_VALUES))

    def domains(self, n: int = MOST_DOMAINS) -> DataFrame:
        return index.facet(self.index.table("docs"), self.facets[0], n)

    def content(self, content_hash: str) -> DataFrame:
        """No row stands for an unknown hash."""
        return self.index.by_hash(content_hash)

    def stats(self) -> DataFrame:
        return self.index.stats()
