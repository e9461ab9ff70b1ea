"""Each operator against brute force or the library, with nulls, empty and odd texts, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomcrawl.llm import dac, decontaminate, jaccard, langid, mainhtml, pieces, pii, prefixcounts, registry, tiff

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  a  b\n\tc ", "<s>a</s> <|endoftext|> x", "a▁b", "don't we've   they'll\n\n 'r x'rest", "ﬁ 𝕏 é \x00 \x1c a", "1234 5678,900!!!  ..", "word, word. word,\nWord. end", "x" * 2000, "The same text stands here twice.", "The same text stands here twice."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string, salt int"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small data set with odd rows, copies and clashing extra columns."""
    rng = random.Random(3)
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(300)] for k, a in (("en", "thernoads"), ("de", "schuntgebä"))}
    rows = [(i, t, None, "s", 0, 1, "k", 2) for i, t in enumerate(ODD)] + [(None, "no id here", "en", None, None, None, None, None)]
    item = " ".join(vocab["en"][:20])
    for i in range(60):
        k = "en" if i % 2 else "de"
        w = [rng.choice(vocab[k]) for _ in range(rng.randint(3, 120))]
        rows.append((100 + i, " ".join(w), k, "s", 0, 1, "k", 2))
        for j in range(i % 4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            rows.append((1000 + 10 * i + j, " ".join(v), k, "s", 0, 1, "k", 2))
    rows.append((5000, f"before it {item} after it", "en", "s", 0, 1, "k", 2))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "If 3 km take 5 minutes then 3 km and Anna walks home")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<p>x</p>"), (2, None, None), (2, "u", ""), (None, "v", "<article>a"), (700, "w", "<b")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def test_pii_base(spark, sf):
    text = "call +1 (743) 555-3824 or mail a.b@c-d.example.com. 10.0.0.256 1.2.3.4 card 4485 7658 8238 8943 7, DE89370400440532013000 a@b"
    got = [(k, text[s:e]) for k, s, e, _ in pii.find(text)]
    assert ("phone", "+1 (743) 555-3824") in got and ("ip", "1.2.3.4") in got and ("email", "a.b@c-d.example.com") in got and ("iban", "DE89370400440532013000") in got
    assert not [x for x in got if x[1] == "10.0.0.256"]
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@+ -()09é") for _ in range(rng.randint(0, 40)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [x[:3] for x in pii.find(t) if x[0] in pii.BASE] == want, t
    rows = {r.doc_id: r for r in registry.QUERIES["op1_pii"](spark, sf).collect()}
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[0].spans == ""


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(codec):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (r, c)).astype(np.uint8) for r, c in ((1, 1), (7, 64), (300, 33))] + [rng.integers(0, 256, (200, 64)).astype(np.uint8)]
    for predictor in (1, 2):
        back = [x[:, :, 0] for _, _, _, x in tiff.decode(tiff.encode(pages, codec, predictor, 1000))]
        assert all((a == b).all() for a, b in zip(pages, back, strict=True))


def test_tiff_pages(spark, sf):
    media = tiff.encode([np.zeros((2, 64), np.uint8), np.ones((3, 64), np.uint8)])
    rows = tiff.explode_pages(spark.createDataFrame([(1, media), (2, None), (3, b"junk"), (4, media[:20])], "i long, m binary"), "i", "m").collect()
    assert [(r.i, r.page, r.height) for r in rows if r.error is None] == [(1, 0, 2), (1, 1, 3)] and {r.i for r in rows if r.error} >= {3}
    for r in registry.QUERIES["op2_tiff_pages"](spark, sf).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)


def test_jaccard(spark, sf):
    rows = docs(spark, sf)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    want = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            want.setdefault(find(i), []).append(d)
    want = {d: min(v) for v in want.values() for d in v}
    got = registry.QUERIES["op3_jaccard_join"](spark, sf).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((d or -1, len(s)) for (d, _), s in zip(rows, sets, strict=True))


def test_jaccard_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(70, 100), replace=False), rng.integers(0, 2**63, 5).astype(np.uint64)])) for _ in range(60)]
    linked = {(i, j) for i in range(60) for j in range(60) if i != j and 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
    root = list(range(60))
    for i, j in sorted(linked):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    own = list(range(60))
    for i, j in jaccard.stars(sets):
        own[j] = i
    assert own == root


def test_langid(spark, sf):
    rows = {r.doc_id: r for r in registry.QUERIES["op4_langid"](spark, sf).collect()}
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == "und" and rows[0].score == 0
    held = [d for d in rows if d is not None and d >= 100 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(rows[d].held_out for d in held) and all(rows[d].lang_pred == labels[d] for d in held)
    model = langid.fit([("a", [["xx", "xy"] * 9]), ("b", [["qq", "qr"] * 9])])
    _, own = model.marginals([model.places(["xx", "xy", "xx", "qq", "qr", "qq"])], every=True)
    assert own[0].argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1]


def test_main_text(spark, sf):
    tree = mainhtml.grow(*mainhtml.labelled_blocks())
    page = '<nav><a href="/x">Menu</a></nav><article><h1>A &amp; B</h1><p>One\n two<p><b>Three<br>four</b><aside>ad</aside><script>var t="</p>";</script></article><footer>f</footer>'
    assert mainhtml.main_text(page, tree) == "A & B One two Three four"
    for odd in ("<", "<a href='", "<!-- x", "<script>", "</", "<p", 'a<b c="d', "&#0;&bogus;"):
        mainhtml.main_text(odd, tree)
    assert {(r.page_id, r.text) for r in registry.QUERIES["op5_main_text"](spark, sf).collect()} >= {(2, ""), (None, "a")}


def test_decontaminate(spark, sf):
    assert {(r.doc_id, r.item_id) for r in registry.QUERIES["op6_decontaminate"](spark, sf).collect()} == {(5000, 1)}
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(1, "so: If 7 km take 9 minutes then 7 km and Berta walks home", True), (2, "If 7 km take 9 minutes then 8 km and Berta walks home", False), (3, "If trains take long then walk home", False)]
    got = decontaminate.contaminated(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.same_values) for r in got] == [(1, 4, False)]


def test_decontaminate_inconsistent_slot(spark):
    """One number that was changed costs the windows that hold it, not the alignment."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(49)]
    passage = lambda a, b: " ".join([*words[:10], str(a), *words[10:40], str(b), *words[40:]])
    items = spark.createDataFrame([(1, passage(300, 300))], "item_id long, text string")
    texts = [(1, passage(300, 400)), (2, passage(400, 300)), (3, passage(3, 5)), (4, passage(7, 7)), (5, " ".join([*words[:10], "300", *words[10:30]]))]
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.n_windows, r.matched, r.same_values) for r in got) == [(1, 47, 42, True), (2, 47, 42, True), (3, 47, 42, False), (4, 47, 47, False)]


def test_decontaminate_names(spark):
    """Names count at sentence starts, behind titles, quotes and any white space; case and wraps never cost a copy."""
    tom = "Tom has 5 apples. Tom gives 2 apples to Mary. How many apples does Tom have left?"
    long = "yesterday we met Anna near the old mill and then Paul came by with bread for the whole village"
    smith = "There was a note from Dr. Smith on the desk, and it said that (Mary) would call \"Peter\" by noon."
    items = spark.createDataFrame([(1, tom), (2, long), (3, smith)], "item_id long, text string")
    texts = [
        (1, "Bob has 7 apples. Bob gives 3 apples to Sue. How many apples does Bob have left?", 1),
        (2, long.replace(" Anna", "\nAnna").replace(" Paul", "\n  Paul"), 2),
        (3, long.lower(), 2),
        (4, tom.upper(), 1),
        (5, smith.replace("Smith", "Jones").replace("Mary", "Eva").replace("Peter", "Carl"), 3),
        (6, "so it is: bob has 7 apples", None),
        (7, "The dog has 7 apples. Bob gives 3 pears to Sue. What many apples does Bob have left?", None),
    ]
    got = decontaminate.contaminated(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(d, i) for d, _, i in texts if i]
    assert {r.doc_id for r in got if r.coverage == 1} == {1, 2, 3, 4, 5} and {r.doc_id for r in got if r.same_values} == {2, 3, 4}


def test_codes(spark, sf):
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 2**31):
        for n in (0, 1, 63, 64, 65, 3000):
            ids = rng.integers(0, top, n).astype(np.uint32)
            r = dac.Reader(dac.pack(ids, np.array([7]), np.array([0, n]), 5))
            assert (r.ids() == ids).all() and all(r.access(i) == ids[i] for i in range(n)) and r.start == 5
            assert (r.slice(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    tok = dac.Encoder(BYTES).tok
    rows, start = sorted(docs(spark, sf), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), 0
    want = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, dac.END]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in registry.QUERIES["op7_dac"](spark, sf).orderBy("start").collect()] == want


def test_pieces(spark, sf):
    sp = pieces.processor(PIECES)
    agenda = pieces.Agenda(PIECES)
    for _, t in docs(spark, sf):
        assert agenda(t or "") == (sp.encode(t) if t else [])
    assert all(r.agrees for r in registry.QUERIES["op8_pieces"](spark, sf).collect())


def test_prefix_counts(spark, sf):
    counter, tok = prefixcounts.PrefixCounter(BYTES), dac.Encoder(BYTES).tok
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for t in (t for t in ODD if t):
        t = t[:120]
        form = counter(t)
        assert [prefixcounts.count_at(form, k) for k in range(len(t) + 1)] == [count(t[:k]) for k in range(len(t) + 1)]
        assert all(count(t[: prefixcounts.cut_for(form, b)]) <= b for b in range(5))
    got = {r.doc_id: r.n_tokens for r in registry.QUERIES["op10_prefix_counts"](spark, sf).collect()}
    assert got == {d: count(t or "") for d, t in docs(spark, sf)}


def test_pipeline(spark, sf, empty):
    out = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert 5000 not in out and 0 not in out and 1 not in out
    assert corpus_pipeline.run(spark, empty).count() == 0
