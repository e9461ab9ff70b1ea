"""HTTP fetch as a partition-wise source: retries, validation, decoding, metadata; the opener is pluggable."""

from __future__ import annotations

import hashlib
import re
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomcrawl.functions.fixed import MEDIA_TYPES, MOST_BYTES

ATTEMPTS, SECONDS = 3, 30
SCHEMA = "url string, success boolean, status int, content_type string, encoding string, content string, content_hash string, content_length long, error string"


def open_url(url: str) -> tuple[int, str, bytes]:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=SECONDS) as r:
        return r.status, r.headers.get("Content-Type", ""), r.read(MOST_BYTES + 1)


def decode(body: bytes, media_type: str) -> tuple[str, str]:
    """(encoding, text) by the header's charset, utf-8 without a known one; bad bytes are replaced."""
    found = re.search(r"charset=[\"']?([\w.:-]+)", media_type or "", re.I)
    encoding = found[1].lower() if found else "utf-8"
    try:
        return encoding, body.decode(encoding, "replace")
    except LookupError:
        return "utf-8", body.decode("utf-8", "replace")


def fetched(url: str, opener: Callable[[str], tuple[int, str, bytes]], pause: float = 1.0) -> tuple:
    error = ""
    for attempt in range(ATTEMPTS):
        try:
            status, media_type, body = opener(url)
        except OSError as e:
            error = str(e)
            if attempt < ATTEMPTS - 1:
                time.sleep(pause * (attempt + 1))
            continue
        main = media_type.partition(";")[0].strip().lower()
        if status >= 400:
            return url, False, status, media_type, None, None, None, None, f"HTTP {status}"
        if main and main not in MEDIA_TYPES:
            return url, False, status, media_type, None, None, None, None, "unsupported content type"
        if len(body) > MOST_BYTES:
            return url, False, status, media_type, None, None, None, None, "content too large"
        encoding, text = decode(body, media_type)
        return url, True, status, media_type, encoding, text, hashlib.sha256(body).hexdigest(), len(body), None
    return url, False, None, None, None, None, None, None, error


def fetch(requests: DataFrame, opener: Callable[[str], tuple[int, str, bytes]] = open_url) -> DataFrame:
    """One row per request (url); failures are rows with their reason."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([fetched(u, opener) for u in b["url"]], columns=names)

    return requests.select("url").mapInPandas(run, SCHEMA)
