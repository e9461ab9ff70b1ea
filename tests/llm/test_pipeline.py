"""The pipeline's stages, each on its own input, against plain versions; the columns; null, empty and repeated rows."""

import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from loomcrawl.llm import common, langid, pieces, pii
from loomcrawl.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"item{a}{b}" for a in "abcde" for b in "vwxyz")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(6)
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(200)] for k, a in (("en", "thernoads"), ("de", "schuntgebä"), ("fr", "liquepovéà"))}
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 ½ !", "en", "s", 6), (None, "thern oads then", "en", None, 3)]
    for i in range(90):
        k = ("en", "de", "fr")[i % 3]
        text = " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(8, 90)))
        rows.append((100 + i, text, k, "s", len(text)))
        if i % 5 == 0:
            rows.append((300 + i, text, k, "t", len(text)))
            rows.append((100 + i, text, k, "s", len(text)))
        if i % 7 == 0:
            rows.append((500 + i, f"{text} write to a.b{i}@host.example.org or +49 30 123456{i % 10} now", k, "s", 1))
        if i % 11 == 0:
            rows.append((700 + i, f"{text} {ITEM} {' '.join(rng.choice(vocab[k]) for _ in range(30))}", k, "s", 1))
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def rows_of(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_language(spark, sf, docs):
    kept = corpus_pipeline.language(spark, docs, sf)
    model = langid.train(docs)
    want = []
    for r in docs.collect():
        words = langid.words_of(r.text or "")
        if words and model.marginals([model.places(words)]).max() >= langid.LEAST:
            want.append(tuple(r))
    assert kept.columns == docs.columns and rows_of(kept) == sorted(map(str, want)) and len(want) >= 100


def test_benchmark_leaks(spark, sf, docs):
    kept = corpus_pipeline.benchmark_leaks(spark, docs, sf)
    assert kept.columns == docs.columns and rows_of(kept) == sorted(str(tuple(r)) for r in docs.collect() if ITEM not in (r.text or ""))


def test_personal_data(spark, sf, docs):
    out = corpus_pipeline.personal_data(spark, docs, sf)
    want = []
    for r in docs.collect():
        text = pii.redact(r.text, pii.find(r.text)) if r.text else r.text
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert out.columns == docs.columns and rows_of(out) == sorted(map(str, want))
    assert not any(re.search(r"@host|\+49", r.text or "") for r in out.collect())


def test_tokens(spark, sf, docs):
    sp = pieces.processor(public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in docs.collect():
        ids = [*(sp.encode(r.text) if r.text else []), 2]
        want.append(str((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())))
    got = corpus_pipeline.tokens(spark, docs, sf).select("doc_id", "n_tokens", "ids_sha256")
    assert rows_of(got) == sorted(want)


def shuffled(spark):
    store, jvm, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, none.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_duplicates_leave_texts_in_place(spark, sf):
    """Where the verdicts are too many to broadcast, only texts that may be judged are shuffled; the kept rows are the same."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(6000)) for _ in range(500)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(900 + i, texts[i], "en", "s", 1) for i in range(5)] + [rows[7], rows[7], (None, texts[9], None, None, None), (None, None, None, None, None), (8, texts[9], "x", "y", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = [*(r for r in rows[:500] if r[0] != 9), rows[-2], rows[-1]]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, path = stored(spark, docs, "texts")
        kept = corpus_pipeline.near_duplicates(spark, docs, sf)
        start = shuffled(spark)
        out, _ = stored(spark, kept, "kept")
        moved = shuffled(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows_of(out) == sorted(map(str, want))
    assert moved < sum(map(len, texts)) / 4


def test_tokens_memory_is_bounded(spark, docs, sf, monkeypatch):
    """Half a million distinct words, then one long run of letters: a worker keeps little of either, and all ids are right."""
    steps = []
    monkeypatch.setattr(pieces, "map_batches", lambda df, schema, make: steps.append(make()) or df)
    common._KEPT.clear()
    corpus_pipeline.tokens(spark, docs, sf)
    run = "".join(chr(0x4E00 + i % 3000) for i in range(20_000))
    texts = [" ".join(f"w{i}x{i * 7919 % 10007}" for i in range(k, k + 5000)) for k in range(0, 500_000, 5000)] + [run]
    for t in texts:
        out = steps[0](pa.RecordBatch.from_arrays([pa.array([1]), pa.array([t])], names=["doc_id", "text"]))
        assert out.column(out.schema.get_field_index("agrees")).to_pylist() == [True]
    agenda = common._KEPT["agenda"][1]
    held = [x for cache in (agenda.whole, agenda.after_blank) for part in (cache, cache.old) for x in part.items()]
    common._KEPT.clear()
    assert len(held) <= 400_000 and sum(len(k) + len(v) for k, v in held) <= 12_000_000 and max(len(k) for k, _ in held) <= 64


def test_run_is_its_stages(spark, sf, docs):
    d = docs
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf)
    out = corpus_pipeline.run(spark, sf)
    assert rows_of(out) == rows_of(d)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and not set(ids) & {1, 2, 3} and not any(i and 300 <= i < 500 or i and i >= 700 for i in ids)
