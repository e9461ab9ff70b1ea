"""op3's rows without ids, exactly one row a component, filters, and random sets against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcrawl.llm import jaccard
from loomcrawl.llm.common import stored

COLUMNS = "doc_id long, text string, key string, row long, n int"


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components(texts):
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) if s else None for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefg" for b in "mnop"]
    texts = [None, "", " \n", "One two", "one TWO", "a b c d e", "a b c d e f"]
    for _ in range(30):
        w = [rng.choice(vocab) for _ in range(rng.choice((3, 8, 20, 60, 150, 400)))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 6)):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 40))):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v))
            w = v if rng.random() < 0.4 else w  # chains
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng, texts = random.Random(seed), corpus(seed)
    ids = [None if rng.random() < 0.3 else rng.choice((i, 2**60 + i, -i)) for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    want, own, sets = [], components(texts), sets_of(texts)
    for i, r in enumerate(own):
        group = [ids[j] for j, x in enumerate(own) if x == r and ids[j] is not None]
        want.append((str(ids[i]), len(sets[i]), str(ids[i] if r is None else min(group, default=None))))
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in rows], COLUMNS).repartition(4)
    got = [(str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar(df).collect()]
    assert sorted(got) == sorted(want)


def test_a_component_keeps_one_row(spark):
    rng, texts = random.Random(9), corpus(9)
    texts += rng.choices(texts, k=60)
    ids = [None if rng.random() < 0.2 else rng.randrange(40) for _ in texts]
    df = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in zip(ids, texts, strict=True)], COLUMNS).repartition(4)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    own, left = components(texts), [(r.doc_id, r.text) for r in kept.collect()]
    least = lambda d: (d is None, d or 0)
    groups = {}
    for i, r in enumerate(own):
        groups.setdefault(r if r is not None else ("empty", i), []).append(i)
    assert len(left) == len(groups)
    for r, members in groups.items():
        best = min((ids[i] for i in members), key=least)
        assert any((ids[i], texts[i]) in left for i in members if ids[i] == best)


def test_keep_one_without_words(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, " ")], "doc_id long, text string")
    assert jaccard.keep_one(df).count() == 3 and jaccard.keep_one(df.where(F.lit(False))).count() == 0


def test_filter_misses_none(spark):
    ids = [*range(0, 2**62, 2**62 // 5000), -5, None]
    found = jaccard.filter_of(spark.createDataFrame([(i,) for i in ids], "rep long").repartition(7))
    assert jaccard.passes(found, np.array([i for i in ids if i is not None])).all()
    assert jaccard.passes(found, np.arange(1, 20_001)).mean() < 0.05
    assert not jaccard.passes(jaccard.filter_of(spark.createDataFrame([], "rep long")), np.arange(9)).any()


def test_sketches_keep_every_linked_set_and_drop_chance_company():
    rng = np.random.default_rng(5)
    for n in (1, 3, 20, 63, 64, 130, 400, 3000):
        base = np.unique(rng.integers(0, 1 << 63, n, np.int64)).astype(np.uint64)
        others = [np.unique(rng.integers(0, 1 << 63, n, np.int64)).astype(np.uint64) for _ in range(6)]
        cut, more = base[: -(-3 * len(base) // 4)], np.unique(np.concatenate([base, rng.integers(0, 1 << 63, n // 3, np.int64).astype(np.uint64)]))
        sets = [base, cut, more, *others]
        got = jaccard.near([jaccard.sketch(x) for x in sets], [len(x) for x in sets])
        linked = {i for pair in jaccard.stars(sets) for i in pair}
        assert all(got[i] for i in linked) and {0, 1} <= linked
        assert n < 20 or not got[3:].any()
    flat = np.arange(0, 1 << 20, 1 << 14, dtype=np.uint64)  # counts that don't fit a byte
    assert jaccard.near([jaccard.sketch(np.repeat(flat, 90))] * 2, [5760, 5760]).all()


def test_chance_company_does_not_travel(spark):
    sets = {k: np.unique(np.random.default_rng(k).integers(0, 1 << 63, 300, np.int64)).astype(np.uint64) for k in (1, 2, 3)}
    sets[4] = sets[1][:280]
    groups = spark.createDataFrame([(1, k) for k in sets], "centre long, member long")
    sketches = spark.createDataFrame([(k, len(x), bytearray(jaccard.sketch(x))) for k, x in sets.items()], "key long, n long, sketch binary")
    assert sorted(r.member for r in jaccard.hopeful(groups, sketches).collect()) == [1, 4]


def test_shuffle_files_go_with_the_write(spark):
    def files():
        return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    before = files()
    stored(spark, spark.range(10_000).groupBy((F.col("id") % 977).alias("k")).count(), "test-shuffle")
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
