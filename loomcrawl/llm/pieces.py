"""SentencePiece encoding of merge-type (BPE) vocabularies by an agenda of adjacent symbol pairs.

Symbols are the characters of the text, blanks written as U+2581 behind a leading one. All adjacent pairs that form a
piece wait in an agenda ordered by the piece's score, then place; the best is merged, and its neighbours enter. Of a
short chunk the agenda is a plain list of the pairs' scores, of a longer one a heap, in which pairs that a merge has
outdated are skipped. Symbols that are no piece become byte pieces, or the unknown piece.

No piece of such a vocabulary has the blank's sign behind another character (checked when a model is read), so a merge
never crosses the place before a blank, and each distinct chunk between such places passes the agenda once per task.
The agenda's ids are what is returned, hashed and decoded. Every text's are compared with the sentencepiece library's in
the same Arrow batch; `agrees` is false where they differ, and strict=True makes that an error.

Defined results: null counts as empty, which is the end id alone; decoding gives the library's text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomcrawl.llm.common import Recent, kept, map_batches, table, texts_of

#: CACHE: distinct chunks that a worker remembers, at most twice as many, some 200 bytes each; those of more than LONGEST
#: characters are merged anew each time, as their number says nothing about their size.
BLANK, END, CACHE, LONGEST = "▁", 2, 900_000, 64
#: Symbols up to which the best pair is sought in a list: at that length it costs less than a heap's upkeep.
LISTED, NONE = 32, float("inf")
_BEFORE_BLANK = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Chunks(Recent):
    def __missing__(self, key: str) -> bytes:
        return super().__missing__(key) if len(key) <= LONGEST else self.value(key)


class Agenda:
    def __init__(self, path: str, cache: int = CACHE):
        self.sp = sp = processor(path)
        kinds = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size())]
        self.piece = {p: (-sp.get_score(i), i) for p, i in kinds if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.cost = {p: cost for p, (cost, _) in self.piece.items()}
        self.byte = {int(p[3:5], 16): i for p, i in kinds if sp.is_byte(i)}
        self.unknown, self.code = sp.unk_id(), "H" if len(kinds) <= 1 << 16 else "I"
        self.decimal = [str(i) for i in range(len(kinds))]
        self.lone = not any(BLANK in p.lstrip(BLANK) for p in self.piece) and not any("\n" in p for p in self.piece)
        #: Stops that no piece has behind a letter or digit: a merge never reaches over the place between.
        self.stop = {c: self.chunk(c) for c in ",." if not any(c in p[1:] and any(a.isalnum() and b == c for a, b in zip(p, p[1:], strict=False)) for p in self.piece)}
        self.whole = Chunks(cache, lambda c: self._packed(self.chunk(c)))
        self.after_blank = Chunks(cache, self._part)

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a string in which blanks are already signs."""
        symbols = self._merged(text) if len(text) > LISTED else self._merged_short(text)
        get = self.piece.get
        out: list[int] = []
        for s in symbols:
            if s:
                if (p := get(s)) is not None:
                    out.append(p[1])
                elif self.byte:
                    out += [self.byte[c] for c in s.encode("utf-8", "surrogatepass")]
                else:
                    out.append(self.unknown)
        return tuple(out)

    def _merged(self, text: str) -> list[str]:
        """Symbols after all merges, with empty ones where a neighbour took them in."""
        get, n = self.cost.get, len(text)
        symbols, left, right = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(p, i, i + 1, 2) for i in range(n - 1) if (p := get(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            a, b = symbols[i], symbols[j]
            if len(a) + len(b) != size or right[i] != j or not a or not b:
                continue
            a += b
            symbols[i], symbols[j] = a, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (p := get(a + (b := symbols[k]))) is not None:
                    heappush(agenda, (p, i, k, size + len(b)))
            if (h := left[i]) >= 0 and (p := get((b := symbols[h]) + a)) is not None:
                heappush(agenda, (p, h, i, size + len(b)))
        return symbols

    def _merged_short(self, text: str) -> list[str]:
        get, symbols = self.cost.get, list(text)
        agenda = [get(text[i : i + 2], NONE) for i in range(len(text) - 1)]
        while agenda and (best := min(agenda)) != NONE:
            i = agenda.index(best)
            symbols[i] = s = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = get(symbols[i - 1] + s, NONE)
            if i < len(agenda):
                agenda[i] = get(s + symbols[i + 1], NONE)
        return symbols

    def _packed(self, ids: tuple[int, ...] | list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Of what stands between two blanks: with the sign of its blank, but for line feeds, which got one here."""
        if len(part) > 1 and part[-1] in self.stop and part[-2].isalnum():
            return self.after_blank[part[:-1]] + self._packed(self.stop[part[-1]])
        return self._packed(self.chunk(part if part[:1] == "\n" else BLANK + part))

    def __call__(self, text: str) -> list[int]:
        return array(self.code, self.packed(text)).tolist()

    def packed(self, text: str) -> bytes:
        """A text's ids as 16-bit numbers, or 32-bit ones in a vocabulary that needs them."""
        if not text:
            return b""
        if not self.lone:
            return self._packed(self.chunk(BLANK + text.replace(" ", BLANK)))
        if text[0] != " " and "  " not in text and " \n" not in text and BLANK not in text:
            cache, parts = self.after_blank, text.replace("\n", " \n").split(" ")
        else:
            cache, parts = self.whole, _BEFORE_BLANK.split(BLANK + text.replace(" ", BLANK))
        return b"".join([cache[p] for p in parts])


def digests(df: DataFrame, path: str, keep: bool = False, strict: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, agrees; with keep also ids array<int> and decoded text.

    A worker remembers cache to twice as many distinct chunks: fewer take less memory and more time.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"] + ["ids", "decoded"] * keep
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.string()]

    def make():
        agenda = kept("agenda", (path, cache), lambda: Agenda(path, cache))
        sp, decimal = agenda.sp, agenda.decimal

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names[1:]]
            for t in texts_of(b.column(1)):
                packed = agenda.packed(t)
                same = packed == array(agenda.code, sp.encode(t, num_threads=1)).tobytes() if t else True
                if strict and not same:
                    raise ValueError(f"the agenda's ids differ from the library's on a text of {len(t)} characters")
                ids = array(agenda.code, packed).tolist()
                ids.append(END)
                decoded = sp.decode(ids)
                row = (len(ids), hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), same, ids, decoded)
                for c, v in zip(columns, row, strict=False):
                    c.append(v)
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=False))], names=names)

        return step

    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean" + ", ids array<int>, decoded string" * keep
    return map_batches(df.select("doc_id", "text"), schema, make)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of every document."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op8_pieces": op8_pieces}
SQL: dict[str, str] = {}
