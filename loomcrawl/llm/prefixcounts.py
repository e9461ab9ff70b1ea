"""Exact token counts at every prefix, by dynamic programming over prefixes.

In byte-pair encoding every prefix of a pre-token has one last token t such that (the last token of what stands before
t, t) is a pair that stays apart when the two are encoded together; the count is one more than the count before t. So
one pass over a pre-token's prefixes gives all their counts. Counts of a text follow by adding up: a prefix that ends
inside a run of white space takes the run so far as its last pre-token, one inside 're, 've or 'll takes the
apostrophe and the letter apart, and one inside an added token's string takes it as ordinary characters.

The stored form is one signed byte per code point, the change of the count there; the sum of the first k of them is
the exact count of text[:k]. Truncation and budget questions are answered from it without encoding again.

Pre-tokens that weren't met before go through the pass together, one prefix length at a time: an automaton over the
vocabulary names the tokens that end at a byte, the longest first, and whether two tokens stay apart is read off the
merges they are made of. Runs of white space, very long pre-tokens and those of vocabularies whose merges aren't
ordered() take the pass one by one.

Defined results: null counts as empty; empty text has no prefix and 0 tokens; any length is stored whole.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomcrawl.llm import bytebpe
from loomcrawl.llm.common import Recent, kept, map_batches, table, texts_of

LIMIT = 512
_PAIRS = 500_000
#: Longer pre-tokens (in bytes) take the pass one by one: few are as long, and a step for one costs as much as for many.
LONG = 128
#: Code points of texts whose missing chunks are asked for together, at least one text, and of chunks counted at once, at least one.
GROUP, BLOCK = 4_000_000, 1_000_000
#: Pairs of tokens whose answer is remembered, as a power of 2; a pair takes the place of the one before it there.
_REMEMBERED = 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


_LETTERS_APART = {"'re", "'ve", "'ll"}
#: Characters that Python takes for white space and the pre-tokenizer doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_RUN = re.compile(rf"[^\S{_SEPARATORS}]{{2,}}")


def blank(c: str) -> bool:
    """White space to the pre-tokenizer."""
    return c.isspace() and c not in _SEPARATORS


def numbered(merges: list[tuple[bytes, bytes]]) -> tuple[list[bytes], dict[bytes, int]]:
    tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
    return tokens, {t: k for k, t in enumerate(tokens)}


def ordered(merges: list[tuple[bytes, bytes]]) -> bool:
    """Whether each merge makes a token of its own from two earlier ones, as training does."""
    tokens, number = numbered(merges)
    return len(number) == len(tokens) and all(number.get(a, k) < k and number.get(b, k) < k for k, (a, b) in enumerate(merges, 256))


class Automaton:
    """The tokens that end at a byte of a pre-token, and which pairs of them stay apart, for arrays of places.

    Tokens are numbered: bytes first, then the merges' products by rank. `follow[state, byte]` is the next state,
    `longest[state]` the longest token that ends there and `shorter[token]` the next that ends at the same byte.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        """merges by rank, for which ordered() holds."""
        tokens, number = numbered(merges)
        self.left = np.array([*range(256), *(number[a] for a, _ in merges)])
        self.right = np.array([*range(256), *(number[b] for _, b in merges)])
        self.length = np.array([len(t) for t in tokens])
        made = self.left[256:] * len(tokens) + self.right[256:]
        order = np.argsort(made)
        self.made, self.product = np.append(made[order], np.iinfo(np.int64).max), np.append(order + 256, 0)
        self.known = np.full(1 << _REMEMBERED, -1)
        self._states(tokens)

    def _states(self, tokens: list[bytes]) -> None:
        state, levels = {b"": 0}, [[] for _ in range(int(self.length.max()) + 1)]
        for t in tokens:
            for e in range(1, len(t) + 1):
                if (p := t[:e]) not in state:
                    state[p] = len(state)
                    levels[e].append(p)
        self.follow = np.zeros((len(state), 256), np.int32)
        self.longest = np.full(len(state), -1, np.int32)
        self.shorter = np.full(len(tokens), -1, np.int32)
        for k, t in enumerate(tokens):
            self.longest[state[t]] = k
        fail = np.zeros(len(state), np.int32)
        for level in levels:
            if not level:
                continue
            own, before, byte = (np.array(x) for x in zip(*((state[p], state[p[:-1]], p[-1]) for p in level), strict=True))
            fail[own] = np.where(before > 0, self.follow[fail[before], byte], 0)
            self.follow[before, byte] = own
            self.follow[own] = self.follow[fail[own]]  # shorter states are whole by now
            ends = self.longest[own] >= 0
            self.shorter[self.longest[own[ends]]] = self.longest[fail[own[ends]]]
            self.longest[own[~ends]] = self.longest[fail[own[~ends]]]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the tokens a, b come out again when their bytes are encoded together."""
        keys = a.astype(np.int64) * len(self.length) + b
        slots = (keys * -7046029254386353131 >> (64 - _REMEMBERED)) & ((1 << _REMEMBERED) - 1)
        found = self.known[slots]
        new = np.flatnonzero(found >> 1 != keys)
        if len(new):
            found[new] = keys[new] * 2 + self._apart(a[new].astype(np.int64), b[new].astype(np.int64))
            self.known[slots[new]] = found[new]
        return (found & 1).astype(bool)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes merges, the later first; a pair across the border that merges earlier than the one undone wins over it."""
        yes, at, limit = np.zeros(len(a), bool), np.arange(len(a)), np.full(len(a), len(self.length))
        while len(at):
            keys = a * len(self.length) + b
            k = np.searchsorted(self.made, keys)
            stays = (self.made[k] != keys) | (self.product[k] >= limit)
            at, a, b = at[stays], a[stays], b[stays]
            whole = (a < 256) & (b < 256)
            yes[at[whole]] = True
            at, a, b = at[~whole], a[~whole], b[~whole]
            first = a > b  # of equal pairs the left one merges first, so b's own merge loses to its equal across
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return yes

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """At each byte of the pre-tokens data[start : start + size] the count of the prefix that ends with it."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))
        last, count, state = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32), np.zeros(len(size), np.int32)
        for j, m in enumerate(active):
            here = start[:m] + j
            state = self.follow[state[:m], data[here]]
            token, before = self.longest[state], np.zeros(m, np.int32)
            open_ = np.flatnonzero(self.length[token] <= j)  # the others reach back to the beginning
            while len(open_):
                t = token[open_]
                at = here[open_] - self.length[t]
                ok = self.apart(last[at], t)
                before[open_[ok]] = count[at[ok]]
                open_ = open_[~ok]
                token[open_] = self.shorter[token[open_]]
            last[here], count[here] = token, before + 1
        return count


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = byte_letters()
        spell = lambda s: bytes(of[c] for c in s)
        self.vocab = {spell(t) for t in model["vocab"] if all(c in of for c in t)}
        self.rank = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[spell(a), spell(b)] = k
        self.longest = max(map(len, self.vocab))
        merges = sorted(self.rank, key=self.rank.get)
        self.automaton = Automaton(merges) if ordered(merges) else None
        self.cut = bytebpe.tokenizer(path).pre_tokenizer.pre_tokenize_str
        self.special = bytebpe.added(path)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words = Recent(bytebpe.CACHE, self._word)
        self.cached = bytebpe.Chunked(self._forms)

    def merge(self, data: bytes) -> list[bytes]:
        """Byte-pair encoding of one pre-token: the pair of least rank first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[k], parts[k + 1]) not in rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def apart(self, a: bytes, b: bytes) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def word(self, text: str) -> list[int]:
        """Counts of the prefixes of one pre-token, one per code point."""
        return self.words[text]

    def _word(self, text: str) -> list[int]:
        data, vocab, longest = text.encode("utf-8", "surrogatepass"), self.vocab, self.longest
        last, count = [b""], [0]
        for j in range(1, len(data) + 1):
            for i in range(max(0, j - longest), j):
                t = data[i:j]
                if t in vocab and (i == 0 or self.apart(last[i], t)):
                    break
            last.append(t)
            count.append(count[i] + 1)
        return count[1:] if len(data) == len(text) else [count[e] for e in itertools.accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]

    def _counts(self, text: str) -> list[int]:
        """Counts of all prefixes of a text without added tokens."""
        out: list[int] = []
        base = run = before = 0
        for _, (s, e) in self.cut(text):
            token = text[s:e]
            if blank(token[0]):  # the run goes on, or begins here
                if not (s and blank(text[s - 1])):
                    run, before = s, base
                end = s
                while end < e and blank(text[end]):
                    end += 1
                whole = self.word(text[run:end])
                out += [before + n for n in whole[s - run :]]
                own = self.word(token)
                out += [base + n for n in own[end - s :]]
            else:
                own = self.word(token)
                if token in _LETTERS_APART:
                    own = [1, 2, own[2]]
                out += [base + n for n in own]
            base += own[-1]
        return out

    @staticmethod
    def _changes(counts: list[int]) -> bytes:
        return np.diff(np.array([0, *counts])).astype(np.int8).tobytes()

    def _forms(self, parts: list[str]) -> list[bytes]:
        """Stored forms of chunks."""
        found, block, size = [None] * len(parts), [], 0
        for k, p in enumerate(parts):
            if p[-1].isspace() or len(p) > 1 and p[:2].isspace():
                found[k] = self._changes(self._counts(p))
                continue
            if block and size + len(p) > BLOCK:
                self._block(parts, block, found)
                block, size = [], 0
            block.append(k)
            size += len(p)
        self._block(parts, block, found)
        return found

    def _block(self, parts: list[str], block: list[int], found: list) -> None:
        """Puts the forms of parts[k], k in block, into found. None begins with a run of white space or ends in white space."""
        ends = list(itertools.accumulate(len(parts[k]) + 1 for k in block))
        form = self._joined("\n".join([parts[k] for k in block]), {e - 1 for e in ends})
        for k, end in zip(block, ends, strict=True):
            found[k] = form[end - 1 - len(parts[k]) : end - 1]

    def _joined(self, text: str, between: set[int]) -> bytes:
        """The stored form of chunks with line feeds between them, each of which is a token and no part of a run."""
        cut = self.cut(text)
        end = np.fromiter((e for _, (_, e) in cut), np.int64, len(cut))
        first = np.append(0, end)[:-1]
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        bound = np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))  # of code points
        start, size = bound[first], bound[end] - bound[first]
        short = size <= (LONG if self.automaton else 0)
        counts = np.zeros(len(bound) - 1, np.int64)
        if short.any():
            counts += self.automaton.counts(data, start[short], size[short])[bound[1:] - 1]
        for k in np.flatnonzero(~short):
            counts[first[k] : end[k]] = self._word(text[first[k] : end[k]])
        for t, (s, _) in cut:
            if t in _LETTERS_APART:
                counts[s : s + 2] = 1, 2
        whole = np.cumsum(counts[end - 1])
        counts += np.repeat(np.append(0, whole)[:-1], end - first)
        for run in _RUN.finditer(text):
            s, e = run.span()
            if s not in between:
                counts[s:e] = np.array(self.word(run[0])) + (counts[s - 1] if s else 0)
        return np.diff(counts, prepend=0).astype(np.int8).tobytes()

    def __call__(self, text: str) -> bytes:
        """The stored form of a text."""
        return self.forms([text])[0]

    def forms(self, texts: list[str]) -> list[bytes]:
        """The stored forms of texts; what they lack is counted together."""
        found, group, size = [], [], 0
        for text in texts:
            if group and size + len(text) > GROUP:
                found += self._group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        return found + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        asked, added = [], []
        for text in texts:
            done = times = 0
            while at := [(k, s) for s in self.special if (k := text.find(s, done)) != -1]:
                k, s = min(at)
                asked += [text[done:k], text[done:k] + s[:-1]]
                done, times = k + len(s), times + 1
            asked.append(text[done:])
            added.append(times)
        found = (b"".join(v) for v in self.cached.values_of(asked))
        return [b"".join([self._closed(next(found), next(found)) for _ in range(times)] + [next(found)]) for times in added]

    @staticmethod
    def _closed(before: bytes, within: bytes) -> bytes:
        """The form up to the end of an added token, from those up to its first and its last code point."""
        last = count_at(before, len(before)) + 1 - count_at(within, len(within))
        return within + last.to_bytes(1, signed=True)


def count_at(changes: bytes, k: int) -> int:
    """Tokens of the first k code points."""
    return int(np.frombuffer(changes, np.int8)[:k].sum(dtype=np.int64))


def cut_for(changes: bytes, budget: int) -> int:
    """The most code points from the start that have at most `budget` tokens."""
    counts = np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def token_counts(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, cut_chars (the longest prefix within the limit) and the stored form `changes`."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long" + ", changes binary" * keep

    def make():
        counter = kept("prefix", path, lambda: PrefixCounter(path))

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            sizes, totals, cuts, forms = [], [], [], []
            texts = texts_of(b.column(1))
            for t, changes in zip(texts, counter.forms(texts), strict=True):
                total = count_at(changes, len(t))
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                totals.append(total)
                cuts.append(len(t) if total <= limit else cut_for(changes, limit))
                if keep:
                    forms.append(changes)
            arrays = [b.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals]), pa.array(cuts, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(forms, pa.binary())] * keep, names=[id_col, "n_bytes", "n_tokens", "over_limit", "cut_chars"] + ["changes"] * keep)

        return step

    return map_batches(df.select(id_col, text_col), schema, make)


def op10_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document from its stored prefix counts."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=False)


QUERIES = {"op10_prefix_counts": op10_prefix_counts}
SQL: dict[str, str] = {}
