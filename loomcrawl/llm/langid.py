"""Language of words and texts by a linear-chain conditional random field.

A word is a run of letters (Unicode category L); a run of more than PIECE letters is cut into words of that length, so
every letter of a text without blanks counts. A word's features are its character n-grams of 2 to 4 between end marks (those at a mark are its affixes), its longer
endings, and the languages whose lexicon of frequent words has it. Feature weights and the transitions between the
languages of neighbouring words are learned together by stochastic gradient ascent on the conditional likelihood.
Training sequences are code-switched on purpose: segments of labelled texts in a row, each word labelled with its
text's language. Forward-backward then gives every word of a text, however long, its language's probability.

The classifier is fitted on a bounded sample: about PER_LANGUAGE labelled texts of each of the LANGUAGES most frequent
languages (by a hash of doc_id), of each at most SEGMENTS runs of SEGMENT words spread evenly over the text. All else
covers every row.

Defined results: null text or text without a letter is `und` with score 0; ties go to the first language in
alphabetical order; without any labelled row everything is `und`; repeated rows give equal results.
"""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.llm.common import kept, map_batches, table, texts_of

UNKNOWN = "und"
PER_LANGUAGE, LANGUAGES, SEGMENTS, SEGMENT = 250, 200, 6, 32
BUCKETS, LEXICON = 1 << 16, 400
#: Words of one forward-backward run over many texts, and distinct words that a task keeps.
RUN_WORDS, CACHE = 400_000, 200_000
#: A text under this share of words in its best language has no clear one (pipeline).
LEAST = 0.35
PIECE = 40
#: Bytes of words that are scored at once, times the number of languages: bounds the table of their n-grams' weights.
SCORED = 1 << 19


class _Letters(dict):
    """For str.translate: letters stay, all else becomes a blank."""

    def __missing__(self, code: int) -> str:
        self[code] = c = chr(code) if chr(code).isalpha() else " "
        return c


_LETTERS = _Letters()


def words_of(text: str) -> list[str]:
    words = text.lower().translate(_LETTERS).split()
    if words and len(max(words, key=len)) > PIECE:
        return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def features(word: str) -> list[int]:
    marked = f"^{word}$".encode("utf-8", "surrogatepass")
    crc, n = zlib.crc32, len(marked)
    grams = {marked[i : i + k] for k in (2, 3, 4) for i in range(n - k + 1)}
    grams.add(marked[-6:])
    return [crc(g) & (BUCKETS - 1) for g in grams]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0))
    return t


_CRC = _crc_table()


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """features() of many words at once: per n-gram the place of its word, ascending, and its bucket."""
    marked = [f"^{w}$".encode("utf-8", "surrogatepass") for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    flat = np.frombuffer(b"".join(marked), np.uint8)
    word = np.repeat(np.arange(len(marked), dtype=np.int64) << 34, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))  # bytes from here to the word's end
    crc, keys = np.full(len(flat), 0xFFFFFFFF, np.uint32), []
    for k in range(1, min(4, len(flat)) + 1):  # crc32 is one-to-one on up to 4 bytes of one length
        crc = crc[: len(flat) - k + 1]
        crc = _CRC[(crc ^ flat[k - 1 :]) & 0xFF] ^ (crc >> 8)
        if k > 1:
            at = np.flatnonzero(left[: len(crc)] >= k)
            keys.append(word[at] | (k - 1) << 32 | (crc[at] ^ np.uint32(0xFFFFFFFF)))
    at = np.flatnonzero(lengths > 4)  # shorter ends are among the others
    keys.append(at << 34 | np.fromiter((zlib.crc32(marked[i][-6:]) for i in at.tolist()), np.int64, len(at)))
    key = np.concatenate(keys)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key >> 34, key & (BUCKETS - 1)


class _Places(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class Model:
    """Weights of a fitted field, and the scores of distinct words: all that places() has numbered are scored together."""

    def __init__(self, languages: list[str], weights: np.ndarray, lexicon: dict[str, int], lexical: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.languages, self.weights, self.lexicon, self.lexical, self.transitions, self.start = languages, weights, lexicon, lexical, transitions, start
        self._place, self._scored = _Places(), 0
        self._scores = np.zeros((1024, len(languages)))

    def worker(self) -> Model:
        """This model, or its equal that the Python worker already has, with the words that it has scored."""
        return kept("langid", zlib.crc32(self.weights.tobytes() + self.transitions.tobytes()), lambda: self)

    def __getstate__(self):
        return {**self.__dict__, "_place": _Places(), "_scored": 0, "_scores": np.zeros((1024, len(self.languages)))}

    def score(self, word: str) -> np.ndarray:
        x = self.weights[features(word)].sum(axis=0)
        mask = self.lexicon.get(word, 0)
        for k in range(len(self.languages)):
            if mask >> k & 1:
                x = x + self.lexical[k]
        return x

    def scores(self, words: list[str]) -> np.ndarray:
        """score() of each word."""
        word, bucket = grams_of(words)
        x = np.add.reduceat(self.weights[bucket], np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])), axis=0)
        for i, mask in enumerate(map(self.lexicon.get, words)):
            if mask:
                for k in range(len(self.languages)):
                    if mask >> k & 1:
                        x[i] += self.lexical[k]
        return x

    def places(self, words: list[str]) -> np.ndarray:
        """Rows of the score table for words; new ones get the next rows."""
        return np.fromiter(map(self._place.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        """The score table, with all words that have a place."""
        if len(self._place) > self._scored:
            new = list(islice(self._place, self._scored, None))
            while len(self._scores) < len(self._place):
                self._scores = np.vstack([self._scores, np.zeros_like(self._scores)])
            ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 2) // max(1, SCORED // len(self.languages))
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(new)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                x = self.scores(new[lo:hi])
                self._scores[self._scored + lo : self._scored + hi] = np.exp(x - x.max(axis=1, keepdims=True))
            self._scored = len(self._place)
        return self._scores

    def forget(self) -> None:
        if len(self._place) > CACHE:
            self._place.clear()
            self._scored = 0

    def marginals(self, sequences: list[np.ndarray], every: bool = False):
        """Per sequence the mean probability of each language over its words; with every also all words' own."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in order])
        flat = np.concatenate([sequences[i] for i in order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        table, step, steps = self.table(), np.exp(self.transitions), int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        forward = np.zeros((len(flat), len(self.languages)))
        a = np.exp(self.start)[None, :] * table[flat[starts]]
        for t in range(steps):
            k = active[t]
            if t:
                a = (a[:k] @ step) * table[flat[starts[:k] + t]]
            a /= a.sum(axis=1, keepdims=True)
            forward[starts[:k] + t] = a
        total = np.zeros((len(order), len(self.languages)))
        b, back = np.ones((0, len(self.languages))), step.T
        for t in range(steps - 1, -1, -1):
            k = active[t]
            if len(b) < k:
                b = np.vstack([b, np.ones((k - len(b), len(self.languages)))])
            at = starts[:k] + t
            m = forward[at] * b
            m /= m.sum(axis=1, keepdims=True)
            total[:k] += m
            if every:
                forward[at] = m
            b = (b * table[flat[at]]) @ back
            b /= b.sum(axis=1, keepdims=True)
        means = np.zeros_like(total)
        means[order] = total / lengths[:, None]
        if not every:
            return means
        own: list = [None] * len(order)
        for i, s, n in zip(order, starts, lengths, strict=True):
            own[i] = forward[s : s + n]
        return means, own


def fit(samples: list[tuple[str, list[list[str]]]], rounds: int = 3, batch: int = 48, length: int = 40, seed: int = 7) -> Model | None:
    """A model from (language, runs of words) rows; None without any."""
    samples = sorted((s for s in samples if any(s[1])), key=lambda s: (s[0], s[1]))
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    rng, n = np.random.default_rng(seed), len(languages)
    index = {x: k for k, x in enumerate(languages)}
    runs: list[list[list[str]]] = [[] for _ in languages]
    counts: list[dict[str, int]] = [{} for _ in languages]
    for lang, own in samples:
        runs[index[lang]] += [r for r in own if r]
        for r in own:
            for w in r:
                counts[index[lang]][w] = counts[index[lang]].get(w, 0) + 1
    lexicon: dict[str, int] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << k
    vocabulary: dict[str, int] = {}
    rows: list[list[int]] = []
    for w in (w for own in runs for r in own for w in r):
        if w not in vocabulary:
            vocabulary[w] = len(rows)
            mask = lexicon.get(w, 0)
            rows.append([*features(w), *(BUCKETS + k for k in range(n) if mask >> k & 1)])
    widest = max(map(len, rows))
    grid = np.full((len(rows), widest), BUCKETS + n)
    for i, r in enumerate(rows):
        grid[i, : len(r)] = r
    coded = [[np.array([vocabulary[w] for w in r]) for r in own] for own in runs]
    weights, trans, start = np.zeros((BUCKETS + n + 1, n)), np.zeros((n, n)), np.zeros(n)
    squares, squares_t, squares_s = np.full_like(weights, 1e-2), np.full_like(trans, 1e-2), np.full_like(start, 1e-2)
    steps = rounds * max(8, min(60, sum(len(r) for own in coded for r in own) // (batch * length)))
    for _ in range(steps):
        words, labels = np.zeros((batch, length), np.int64), np.zeros((batch, length), np.int64)
        for i in range(batch):
            at = 0
            while at < length:  # a language keeps on for some 16 words
                k = int(rng.integers(n))
                r = coded[k][int(rng.integers(len(coded[k])))]
                r = r[int(rng.integers(max(1, len(r) - 4))) :][: int(rng.geometric(1 / 16)) + 1][: length - at]
                words[i, at : at + len(r)], labels[i, at : at + len(r)] = r, k
                at += len(r)
        cells = grid[words]
        emit = weights[cells].sum(axis=2)
        top = emit.max(axis=2, keepdims=True)
        e, move = np.exp(emit - top), np.exp(trans)
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        for t in range(length):
            a = np.exp(start) * e[:, 0] if t == 0 else (alpha[:, t - 1] @ move) * e[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b = (beta[:, t + 1] * e[:, t + 1]) @ move.T
            beta[:, t] = b / b.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        truth = np.eye(n)[labels]
        pair = alpha[:, :-1, :, None] * move * (beta[:, 1:] * e[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        seen = np.zeros((n, n))
        np.add.at(seen, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
        grad_t = (seen - pair.sum(axis=(0, 1))) / batch
        grad_s = (truth[:, 0] - post[:, 0]).mean(axis=0)
        used, where = np.unique(cells, return_inverse=True)
        delta = np.repeat((truth - post).reshape(-1, n), widest, axis=0)
        grad = np.stack([np.bincount(where.ravel(), delta[:, k], len(used)) for k in range(n)], axis=1) / batch
        squares[used] += grad**2
        weights[used] += 0.1 * grad / np.sqrt(squares[used])
        weights[-1] = 0
        squares_t += grad_t**2
        trans += 0.1 * grad_t / np.sqrt(squares_t)
        squares_s += grad_s**2
        start += 0.1 * grad_s / np.sqrt(squares_s)
    return Model(languages, weights[:BUCKETS].copy(), lexicon, weights[BUCKETS : BUCKETS + n].copy(), trans, start)


def spread_runs(words: list[str]) -> list[list[str]]:
    """At most SEGMENTS runs of SEGMENT words, evenly over the whole."""
    if len(words) <= SEGMENT * SEGMENTS:
        return [words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT)]
    return [words[(s := k * (len(words) - SEGMENT) // (SEGMENTS - 1)) : s + SEGMENT] for k in range(SEGMENTS)]


def held_out():
    return (F.crc32(F.col("doc_id").cast("string")) % 4 == 2) & F.col("doc_id").isNotNull()


def train(docs: DataFrame) -> Model | None:
    """A model from the rows of docs (doc_id, text, lang) that have a label and aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, PER_LANGUAGE / n)))])
    drawn = known.where((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) < share[F.col("lang")]).select("lang", "text")

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            runs = [spread_runs(words_of(t)) for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, pa.list_(pa.list_(pa.string())))], names=["lang", "runs"])

        return step

    rows = map_batches(drawn, "lang string, runs array<array<string>>", make).collect()
    return fit([(r.lang, [list(x) for x in r.runs]) for r in rows])


def _grouped(model: Model, texts: list[str]):
    """(places in texts, sequences) of texts with words, in groups of about RUN_WORDS words and alike in length."""
    place, held = [], []
    lists = [(i, words_of(t)) for i, t in enumerate(texts)]
    size = 0
    for i, words in sorted((x for x in lists if x[1]), key=lambda x: -len(x[1])):
        place.append(i)
        held.append(words)
        size += len(words)
        if size >= RUN_WORDS:
            model.forget()
            yield place, held, [model.places(w) for w in held]
            place, held, size = [], [], 0
    if place:
        model.forget()
        yield place, held, [model.places(w) for w in held]


def _slices(texts: list[str], chars: int = 3_000_000):
    """Index ranges of texts with about so many characters each: bounds what is split into words at once."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def predict(df: DataFrame, model: Model | None) -> DataFrame:
    """df's columns and lang_pred, score (the mean probability of that language over all words)."""
    taken = [c for c in df.columns if c not in ("lang_pred", "score")]
    at = taken.index("text")

    def make():
        own = model and model.worker()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(b.column(at))
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if own is not None:
                for lo, hi in _slices(texts):
                    for place, _, sequences in _grouped(own, texts[lo:hi]):
                        means = own.marginals(sequences)
                        for i, k, x in zip(place, means.argmax(axis=1), means.max(axis=1), strict=True):
                            langs[lo + i], scores[lo + i] = own.languages[k], min(1.0, float(x))
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*taken, "lang_pred", "score"])

        return step

    schema = df.select(*taken).schema.add("lang_pred", "string").add("score", "double")
    return map_batches(df.select(*taken), schema, make, rows=10_000)


def label_words(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words in one language, in order: id, first word's place, number of words, language, mean probability."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, out, ids = texts_of(b.column(1)), [], []
            for lo, hi in _slices(texts):
                for place, _, sequences in _grouped(model, texts[lo:hi]):
                    _, own = model.marginals(sequences, every=True)
                    for i, m in zip(place, own, strict=True):
                        best = m.argmax(axis=1)
                        cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
                        for s, e in zip(cuts, cuts[1:], strict=False):
                            ids.append(lo + i)
                            out.append((s, e - s, model.languages[best[s]], float(m[s:e, best[s]].mean())))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64()]
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *(pa.array([r[k] for r in out], kinds[k]) for k in range(4))], names=[id_col, "first", "words", "lang", "probability"])

        return step

    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, first long, words long, lang string, probability double"
    return map_batches(df.select(id_col, text_col), schema, make)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, from a model fitted on those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, reference: DataFrame) -> DataFrame:
    """Pipeline stage: docs whose language is known and clear; the model is fitted on reference."""
    return predict(docs, train(reference)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST)).select(*docs.columns)


QUERIES = {"op4_langid": op4_langid}
SQL: dict[str, str] = {}
