"""Cutting texts where no byte-level BPE token can cross, so that each distinct chunk is encoded once per task.

The pre-tokenizer of these vocabularies puts a blank in front of the word that follows it. A blank or line feed that
stands between two characters that are not white space therefore always begins a token, whatever the classes of the
characters around it. A comma or full stop between a letter or digit and white space is a token of its own. Chunks
begin at such places and nowhere else; longer runs of white space stay inside a chunk.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable

#: Distinct chunks that a worker keeps at least, and at most twice. Bounds memory, never results.
CACHE = 500_000

_TWO = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def plain(text: str) -> bool:
    """No white space at either end and none next to another: every blank is a cut."""
    return bool(text) and not text[0].isspace() and not text[-1].isspace() and not _TWO.search(text)


def chunks(text: str) -> list[str]:
    return _CUT.split(text)


def tokenizer(path: str):
    """The tokenizers library's tokenizer, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added(path: str) -> list[str]:
    """The added tokens of a tokenizer file, which the library looks for before it cuts a text."""
    import json

    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


class Chunked:
    """value(chunk) for all chunks of a text, remembered; missing ones are asked for together.

    Values are byte strings that concatenate. A chunk that ends in a stop is put together of its two tokens' parts.
    """

    def __init__(self, ask: Callable[[list[str]], list], size: int = CACHE):
        self.size = size
        self.ask, self.whole, self.after_blank, self.stops = ask, ({}, {}), ({}, {}), {}

    def values(self, text: str) -> list:
        if not plain(text):
            return self._of("whole", chunks(text), str) if text else []
        first, *parts = text.replace("\n", " \n").split(" ")
        return self._of("whole", [first], str) + self._of("after_blank", parts, as_chunk)

    def values_of(self, texts: list[str]) -> list[list]:
        """values() of each text; what they lack is asked for together."""
        whole, after_blank, bounds = [], [], [(0, 0)]
        for text in texts:
            if not plain(text):
                whole += chunks(text) if text else []
            else:
                first, *parts = text.replace("\n", " \n").split(" ")
                whole.append(first)
                after_blank += parts
            bounds.append((len(whole), len(after_blank)))
        whole, after_blank = self._of("whole", whole, str), self._of("after_blank", after_blank, as_chunk)
        return [whole[a:b] + after_blank[c:d] for (a, c), (b, d) in itertools.pairwise(bounds)]

    def _of(self, name: str, parts: list[str], chunk: Callable[[str], str]) -> list:
        new, old = getattr(self, name)
        try:
            return [new[p] for p in parts]
        except KeyError:
            pass
        if len(new) > self.size:
            new, old = {}, new
            setattr(self, name, (new, old))
        missing, stopped = {}, []
        for p in set(parts).difference(new):
            if p in old:
                new[p] = old[p]
            elif len(p) > 2 and p[-1] in ",." and p[-2].isalnum():
                stopped.append(p)
                if (stem := p[:-1]) not in new and stem not in old:
                    missing[stem] = None
            else:
                missing[p] = None
        if missing:
            new.update(zip(missing, self.ask([chunk(p) for p in missing]), strict=True))
        for p in stopped:
            stem = p[:-1]
            new[p] = (new[stem] if stem in new else old[stem]) + self._stop(p[-1])
        return [new[p] for p in parts]

    def _stop(self, stop: str):
        if stop not in self.stops:
            self.stops[stop] = self.ask([stop])[0]
        return self.stops[stop]


def as_chunk(part: str) -> str:
    """The chunk of a part between blanks: with its blank, but for line feeds, which got one here."""
    return part if part[0] == "\n" else f" {part}"
