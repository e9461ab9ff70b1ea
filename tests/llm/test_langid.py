"""op4: marginals against all paths, learned transitions, letters, texts without blanks, its sample's bound."""

import itertools
import math
import random
import re
import time
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from loomcrawl.llm import langid


def model():
    rng = random.Random(1)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(40)] for k, a in (("a", "abcde"), ("b", "defgh"), ("c", "aehxy"))}
    return langid.fit([(k, [[rng.choice(w) for _ in range(32)] for _ in range(12)]) for k, w in words.items()], rounds=2), words


def test_marginals_against_all_paths():
    m, words = model()
    rng, n = random.Random(2), len(m.languages)
    sequences = [[rng.choice(words[rng.choice("abc")]) for _ in range(size)] for size in (1, 2, 5, 7, 3, 3)]
    means, own = m.marginals([m.places(s) for s in sequences], every=True)
    for s, mean, got in zip(sequences, means, own, strict=True):
        scores, total, brute = [m.score(w) for w in s], 0.0, np.zeros((len(s), n))
        for path in itertools.product(range(n), repeat=len(s)):
            weight = math.exp(m.start[path[0]] + sum(x[k] for x, k in zip(scores, path, strict=True)) + sum(m.transitions[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for t, k in enumerate(path):
                brute[t, k] += weight
        assert np.allclose(got, brute / total, atol=1e-9) and np.allclose(mean, (brute / total).mean(axis=0), atol=1e-9)


def test_transitions_are_learned():
    m, words = model()
    assert all(m.transitions[k, k] > m.transitions[k, j] for k in range(3) for j in range(3) if j != k)
    doubtful = [w for w in words["a"] if set(w) <= set("ae")][:1] or ["ae"]
    amid = lambda k: m.marginals([m.places([*words[k][:6], *doubtful, *words[k][6:12]])], every=True)[1][0][6]
    assert amid("a")[0] > amid("c")[0] and amid("c")[2] > amid("a")[2]


def test_letters():
    assert [langid.words_of(t) for t in ("½ ² Ⅷ 12 _ ③", "", "a1b", "ÄÖ ß", "日本語 x")] == [[], [], ["a", "b"], ["äö", "ß"], ["日本語", "x"]]
    rng = random.Random(3)
    for c in map(chr, rng.sample([i for i in range(0x110000) if not 0xD800 <= i < 0xE000], 30_000)):
        assert bool(langid.words_of(c)) == any(unicodedata.category(x)[0] == "L" for x in c.lower()), hex(ord(c))


def test_long_words_count_whole():
    m, words = model()
    head = "zz" * 20
    texts = [head + "".join(words[k]) for k in "abc"]
    means = m.marginals([m.places(langid.words_of(t)) for t in texts])
    assert means.argmax(axis=1).tolist() == [0, 1, 2]
    run = "".join(chr(0x4E00 + i % 500) for i in range(100_003))
    assert "".join(langid.words_of(run)) == run and max(map(len, langid.words_of(run))) == langid.PIECE


def test_und_and_dirty_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, t, k) for i, (t, k) in enumerate([("ab ba ab ab", "a"), ("xy yx xy yx", "b")] * 20 + [("qq rr", f"dirt{j}") for j in range(30)])]
    docs = spark.createDataFrame([*rows, (900, "½ ² Ⅷ", None), (901, None, None), (902, "", "a"), (None, "ab", "a")], "doc_id long, text string, lang string")
    m = langid.train(docs)
    assert m.languages == ["a", "b"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs.select("doc_id", "text"), m).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[0][0] == "a" and got[1][0] == "b" and got[None][0] == "a"
    assert langid.predict(docs.where(F.lit(False)), m).collect() == [] and langid.train(docs.where(F.lit(False))) is None


def test_label_words(spark):
    m, words = model()
    text = " ".join([*words["a"][:9], "12", *words["b"][:9]])
    rows = langid.label_words(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), m).orderBy("first").collect()
    assert [(r.doc_id, r.lang) for r in rows] == [(1, "a"), (1, "b")] and sum(r.words for r in rows) == 18 and abs(rows[1].first - 9) <= 1


def test_words_are_runs_of_letters():
    """Against a plain pattern, over all kinds of characters, with long runs and letters that change in lower case."""
    numbers = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha())
    plain = re.compile(rf"[^\W\d_{re.escape(numbers)}]{{1,{langid.PIECE}}}")
    rng, pools = random.Random(4), [range(32, 127), range(128, 0x250), range(0x370, 0x3000), range(0x4E00, 0x9FFF), range(0x10000, 0x20000), range(0x20000, 0x2FA1F)]
    for _ in range(600):
        t = "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.choice((0, 1, 5, 50, 200))))
        t += rng.choice(("", "İΣ ΑΣ", "x" * rng.randint(30, 130), "½a²b_c3d\x1fe\u2028f"))
        assert langid.words_of(t) == plain.findall(t.lower()), repr(t)


def test_words_scored_together():
    """The same as one by one: repeated n-grams, short and long words, several bytes a letter, words of the lexicon."""
    m, words = model()
    rng = random.Random(5)
    some = ["", "a", "aa", "aaaa", "aaaaaaaa", "abababab", "é", "éé", "日本", "𐐨𐐨𐐨", *words["a"], *("".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 40))) for _ in range(3000))]
    assert np.allclose(m.scores(some), [m.score(w) for w in some], rtol=0, atol=1e-12)
    assert np.allclose(m.scores(["a"]), [m.score("a")], rtol=0, atol=1e-12)
    old = langid.SCORED
    langid.SCORED = 60  # a few words at once
    places, langid.SCORED = (m.places(some), m.table())[0], old
    one = np.array([m.score(w) for w in some])
    assert np.allclose(m.table()[places], np.exp(one - one.max(axis=1, keepdims=True)), rtol=1e-12)


def test_cost_of_new_words():
    """Rare words are many: scoring 40,000 takes less than half of what one by one takes, in this process."""
    m, _ = model()
    words = [f"{a}{b}{c}" for a, b, c in itertools.product(("the", "and", "ing", "rend"), *([["".join(x) for x in itertools.product("abcdefghij", repeat=2)]] * 2))]
    start = time.process_time()
    for w in words:
        x = m.score(w)
        np.exp(x - x.max())
    one_by_one, start = time.process_time() - start, time.process_time()
    m.marginals([m.places(words[i : i + 40]) for i in range(0, len(words), 40)])
    assert time.process_time() - start < one_by_one / 2
