"""op6 against a brute-force reading of its rules on random templates, number words, shuffled joins, shared ids."""

import random

import pytest

from loomcrawl.llm import decontaminate
from loomcrawl.llm.decontaminate import COVER, WINDOW

WORDS = [f"w{a}{b}" for a in "abcd" for b in "xyz"]
NAMES = ["Anna", "Berta", "Carl", "Dora"]
NUMBERS = ["2", "7", "31", "five", "twelve"]


def kind(w):
    return "number" if w in NUMBERS else "name" if w in NAMES else "word"


def meets(own, met):
    """Do two windows have equal templates, with names as placeholders or in lower case?"""
    as_names = all(kind(a) == kind(b) == "number" or kind(b) == "name" == kind(a) or kind(b) != "name" and a.lower() == b.lower() for a, b in zip(own, met, strict=True))
    in_lower = all(kind(a) == kind(b) == "number" or a.lower() == b.lower() for a, b in zip(own, met, strict=True))
    return as_names or in_lower


def brute(text, item):
    """(matched windows, all verbatim) of a text's best alignments with an item; word lists."""
    size = min(WINDOW, len(item))
    found, verbatim = set(), True
    for diagonal in range(-len(item), len(text)):
        windows = [i for i in range(len(item) - size + 1) if 0 <= i + diagonal <= len(text) - size and meets(item[i : i + size], text[i + diagonal : i + diagonal + size])]
        slots = {}
        for i in windows:
            for p in range(i, i + size):
                if kind(item[p]) != "word":
                    slots.setdefault((item[p].lower(), text[p + diagonal].lower()), set()).add(p)
        bound = {}
        for (own, met), places in sorted(slots.items(), key=lambda x: (-len(x[1]), x[0][0] != x[0][1], min(x[1]), x[0][1])):
            bound.setdefault(own, met)
        for i in windows:
            pairs = [(item[p].lower(), text[p + diagonal].lower()) for p in range(i, i + size) if kind(item[p]) != "word"]
            same = all(a == b for a, b in pairs)
            if same or all(bound[a] == b for a, b in pairs):
                found.add(i)
                verbatim &= same
    return len(found), verbatim


def sentence(rng, n):
    out = ["start"]
    while len(out) < n:
        out.append(rng.choice(rng.choice((WORDS, WORDS, NUMBERS, NAMES))))
    return out


def changed(rng, words, how):
    out = list(words)
    if how == "renamed":
        names, numbers = dict(zip(NAMES, rng.sample(NAMES, 4), strict=True)), dict(zip(NUMBERS, rng.sample(NUMBERS, 5), strict=True))
        out = [numbers.get(w, names.get(w, w)) for w in out]
    elif how == "noisy":
        for _ in range(rng.randint(1, 3)):
            out[rng.randrange(1, len(out))] = rng.choice(WORDS + NAMES + NUMBERS)
    elif how == "lower":
        out = [w.lower() for w in out]
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_random_templates(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rng = random.Random(5)
    items = [sentence(rng, rng.choice((3, 4, 6, 10, 18, 30))) for _ in range(25)]
    texts = []
    for _ in range(150):
        own = changed(rng, rng.choice(items), rng.choice(("renamed", "noisy", "lower", "same")))
        if rng.random() < 0.3:
            own = own[: rng.randint(1, len(own))]
        texts.append(["so", *rng.choices(WORDS, k=rng.randint(0, 5)), *own, *rng.choices(WORDS, k=rng.randint(0, 5))])
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            matched, verbatim = brute(text, item)
            if matched >= COVER * (len(item) - min(WINDOW, len(item)) + 1):
                want[d, i] = (matched, verbatim)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.same_values) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and len(want) > 60


def test_number_words(spark):
    item = "If a train needs 5 minutes for 3 miles then how far does it get in twelve hours of the night"
    texts = [
        (1, item.replace("5 minutes", "seven minutes").replace("3 miles", "two miles").replace("twelve", "9"), True),
        (2, item.replace("5", "Eight").replace("twelve", "TWENTY"), True),
        (3, "If a dog needs 5 bones for 3 days then how far does it get in twelve parks of the town", False),
    ]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), bench).collect()}
    assert got == {d for d, _, hit in texts if hit}


def test_shared_ids(spark):
    """Halves of an item in two texts of one doc_id don't make it up; of such rows only the one that holds it goes."""
    item = [f"p{a}{b}" for a in "abcdefgh" for b in "xyz"]
    docs = spark.createDataFrame([(1, " ".join(item[:14])), (1, " ".join(item[8:])), (2, " ".join(item)), (2, "clean words only"), (None, " ".join(item)), (None, "fine"), (3, None), (2, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (None, " ".join(item))], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(0, 0), (0, 1), (2, 0), (2, 1)]
    left = sorted((r.doc_id or 0, r.text or "") for r in decontaminate.keep_clean(docs, bench).collect())
    assert left == sorted([(1, " ".join(item[:14])), (1, " ".join(item[8:])), (2, "clean words only"), (0, "fine"), (3, "")])


def test_false_positives(spark):
    """Of the documents at sf0.01 none but those with an item's own words is taken."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    plain = lambda t: " ".join((t or "").lower().split())
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    held = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t and t in plain(r.text)}
    assert held <= got and len({d for d, _ in got}) <= len({d for d, _ in held}) * 1.5 + 2, (len(held), len(got))
