"""Prefix counts of many pre-tokens at once, against the library and the merges themselves."""

import json
import random

import numpy as np
import public_tokenizers
import pytest

from loomcrawl.llm import bytebpe, prefixcounts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\n\n", "\t", "a", "x" * 9, "'re", "'ll", "'s", "é", "𝕏", "中", "1", "²", ",", ".", "!", "<|endoftext|>", "<|endo", "\x1c", "\x1f", "\xa0", " ", "the", " word", " thtion", "́", "🙂", "\r\n", "==", "%%%"]


@pytest.fixture(scope="module")
def counter():
    return prefixcounts.PrefixCounter(BYTES)


@pytest.fixture(scope="module")
def tok():
    return bytebpe.tokenizer(BYTES)


def total(form):
    return prefixcounts.count_at(form, len(form))


def odd(n, pieces, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, pieces))) for _ in range(n)]


def test_words_are_counted_together(counter, tok, monkeypatch):
    """Ordinary texts take no pass of a single pre-token, and one cut for all of them."""
    rng = random.Random(2)
    syllables = ["tion", "er", "the", "qué", "on", "ß", "st", "an", "中"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(40)) + end for end in (".", ", then", "\nNew line!") for _ in range(40)]
    fresh, cuts = prefixcounts.PrefixCounter(BYTES), []
    monkeypatch.setattr(prefixcounts.PrefixCounter, "_word", lambda *_: pytest.fail("a single pre-token"))
    cut = fresh.cut
    fresh.cut = lambda text: cuts.append(len(text)) or cut(text)
    assert [total(f) for f in fresh.forms(texts)] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(cuts) < 8


def test_pairs(counter):
    """Undoing merges tells the same pairs apart as merging them again."""
    rng = np.random.default_rng(1)
    tokens = prefixcounts.numbered(sorted(counter.rank, key=counter.rank.get))[0]
    for top in (len(tokens), 3000, 500):
        a, b = rng.integers(0, top, 3000), rng.integers(0, top, 3000)
        want = [counter.apart(tokens[x], tokens[y]) for x, y in zip(a, b, strict=True)]
        assert counter.automaton.apart(a, b).tolist() == want == counter.automaton.apart(a, b).tolist()


@pytest.mark.parametrize("sizes", [None, (1, 1, 0), (40, 7, 5)])
def test_every_prefix(tok, monkeypatch, sizes):
    """Odd texts, with separators that only Python takes for white space, at any size of groups, blocks and pre-tokens."""
    if sizes:
        for name, size in zip(("GROUP", "BLOCK", "LONG"), sizes, strict=True):
            monkeypatch.setattr(prefixcounts, name, size)
    texts = ["\n\xa0\x1c", "!a\r\n\xa0\x1c", "\x1c\xa0\xa0b", *odd(250, 9)]
    for t, form in zip(texts, prefixcounts.PrefixCounter(BYTES).forms(texts), strict=True):
        want = [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert [prefixcounts.count_at(form, k) for k in range(len(t) + 1)] == want, ascii(t)


def test_totals(counter, tok):
    texts = [*odd(3000, 40), "x" * 1500, " y" + "ab" * 300, " " * 600 + "z", "\n" * 500, ""]
    assert [total(f) for f in counter.forms(texts)] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_many_added_tokens(counter):
    assert total(counter("a<|endoftext|>" * 1500)) == 3000


def test_merges_out_of_order(tmp_path):
    """A vocabulary that makes a token twice takes the pass one by one."""
    model = json.loads(open(BYTES, encoding="utf-8").read())
    letters = [*prefixcounts.byte_letters()]
    model["model"] |= {"vocab": {t: k for k, t in enumerate([*letters, "ab", "bc", "abc"])}, "merges": [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]}
    model["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(model), encoding="utf-8")
    counter, tok = prefixcounts.PrefixCounter(str(path)), bytebpe.tokenizer(str(path))
    assert counter.automaton is None
    for t in ("abc abcab bcabc", "aabbcc  abc\n"):
        assert [prefixcounts.count_at(counter(t), k) for k in range(len(t) + 1)] == [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
