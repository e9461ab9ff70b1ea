"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns; a match that fails
its check (parts over 255, Luhn, digit counts) is dropped without a second try. The method adds further kinds:
`iban` (its country's length, mod-97), `card_short` (13 to 15 digits, Luhn, a payment word nearby) and `ssn` (numbers
that are given out, a word nearby).
A base span's score never falls below ACCEPT, an added span is kept from ACCEPT on.

Defined results: null text counts as empty and has no spans; any length is scanned whole in linear time; equal
rows give equal results; an empty table gives an empty result; other columns of the input don't matter.
Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.llm.common import map_batches, table, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "card_short", "ssn")
ACCEPT = 0.5
#: Code points of context looked at on either side of a span.
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: The length of an IBAN by country (ISO 13616).
IBAN_LENGTH = {
    k: int(n)
    for k, n in (
        x.split(":")
        for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30".split()
    )
}
_IBAN = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(f'{k}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}' for k, n in IBAN_LENGTH.items())})(?![A-Za-z0-9])")

#: Start score of a kind whose check has passed, and words that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "card_short": 0.3, "ssn": 0.3}
RAISE = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "cvv"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "card_short": ("card", "visa", "amex", "american express", "credit", "debit", "payment", "cvv"),
    "ssn": ("ssn", "social security"),
}
LOWER = {"ip": ("version", "release", "section"), "card": ("isbn", "order", "tracking"), "phone": ("version",), "card_short": ("isbn", "order", "tracking"), "ssn": ("part no", "serial")}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d += d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(t: str):
    low, at = 0, t.find("@")
    while at != -1:
        s = at
        while s > low and t[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(t, at + 1)):
            low = m.end()
            yield "email", s, low
            at = t.find("@", low)
        else:
            at = t.find("@", at + 1)


def _numbers(t: str):
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _DIGITS.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card" if len(digits) >= 16 else "card_short", *m.span()
    for m in _SSN.finditer(t):
        yield "ssn", *m.span()
    for m in _IBAN.finditer(t):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()


def _phones(t: str):
    for m in _PHONE.finditer(t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", *m.span()


def score(kind: str, text: str, start: int, end: int) -> float:
    """Prior of the kind, changed by words within CONTEXT code points; base kinds stay at ACCEPT or above."""
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()
    x = PRIOR[kind]
    x += 0.3 if any(re.search(rf"(?<![a-z]){re.escape(w)}", near) for w in RAISE[kind]) else 0
    x -= 0.3 if any(re.search(rf"(?<![a-z]){re.escape(w)}", near) for w in LOWER.get(kind, ())) else 0
    return round(min(1.0, max(x, ACCEPT if kind in BASE else 0.0)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score), by kind as in KINDS, then by start.

    An added span that overlaps a base span is left out: the base span already covers it.
    """
    raw = [*(_emails(text) if "@" in text else ()), *(_phones(text) if "+" in text else ()), *_numbers(text)]
    base = sorted((s, e) for k, s, e in raw if k in BASE) if any(k not in BASE for k, _, _ in raw) else []
    starts, reach = [s for s, _ in base], list(itertools.accumulate((e for _, e in base), max))  # how far the first ones go

    def free(s: int, e: int) -> bool:
        before = bisect.bisect_left(starts, e)
        return not before or reach[before - 1] <= s

    kept = [(k, s, e, x) for k, s, e in raw if (x := score(k, text, s, e)) >= ACCEPT and (k in BASE or free(s, e))]
    return sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def detect_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans array<struct<kind,start,end,score>>, redacted text (null stays null)."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            found = [find(t) if t else [] for t in texts]
            spans = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in f] for f in found]
            clean = [redact(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(clean, pa.string())], names=[id_col, "spans", "redacted"])

        return step

    return map_batches(df.select(id_col, text_col), schema, make)


def _written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document; n_* and base_sha256 describe the base kinds, spans lists all."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[list[int]] = [[] for _ in BASE]
            sha, spans, extra, low = [], [], [], []
            for t in texts_of(b.column(1)):
                f = find(t)
                base = [x for x in f if x[0] in BASE]
                for c, k in zip(counts, BASE, strict=True):
                    c.append(sum(x[0] == k for x in base))
                sha.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(f))
                extra.append(len(f) - len(base))
                low.append(min((x[3] for x in f), default=None))
            return pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(spans, pa.string()), pa.array(extra, pa.int64()), pa.array(low, pa.float64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "min_score"],
            )

        return step

    return map_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, min_score double", make)


def redact_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the columns of docs, personal data in text replaced, n_chars counted anew (null text: null)."""
    names = docs.columns

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            clean = [redact(t, find(t)) if t else t for t in b.column(names.index("text")).to_pylist()]
            return b.set_column(names.index("text"), "text", pa.array(clean, pa.string()))

        return step

    done = map_batches(docs, docs.schema, make)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else done


QUERIES = {"op1_pii": op1_pii}
SQL: dict[str, str] = {}
