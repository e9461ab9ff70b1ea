"""op8: the returned ids are the agenda's, and a difference from the library is seen."""

import hashlib
import random

import public_tokenizers
import pytest

from loomcrawl.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_agenda_on_random_texts():
    sp, agenda, rng = pieces.processor(PATH), pieces.Agenda(PATH), random.Random(1)
    alphabets = ["ab .", "aeinrst ", "äöüß, .", "日本語のテスト", "0123456789.,-", "▁ \n\ta", "".join(map(chr, range(32, 127))), "🙂é́‍x "]
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice((1, 2, 5, 20, 60, 200))))
        assert agenda(t) == sp.encode(t), repr(t)


def test_ids_are_the_agendas(spark, tmp_path):
    rows = [(1, "some words of text"), (2, None), (3, ""), (None, "x")]
    sp = pieces.processor(PATH)
    got = {r.doc_id: r for r in pieces.digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH, keep=True, strict=True).collect()}
    for d, t in rows:
        ids = [*(sp.encode(t) if t else []), pieces.END]
        r = got[d]
        assert (r.n_tokens, list(r.ids), r.agrees) == (len(ids), ids, True) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_a_wrong_agenda_is_seen(monkeypatch):
    """With an agenda that gives other ids these are returned, and flagged or refused."""
    import pyarrow as pa

    from loomcrawl.llm import common

    class Wrong(pieces.Agenda):
        def packed(self, text):
            return super().packed(text)[2:]

    steps = []
    monkeypatch.setattr(pieces, "Agenda", Wrong)
    monkeypatch.setattr(pieces, "map_batches", lambda df, schema, make: steps.append(make) or df)

    class Frame:
        schema = {"doc_id": type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "bigint"})()})()}
        select = lambda self, *c: self

    common._KEPT.clear()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of text"])], names=["doc_id", "text"])
    pieces.digests(Frame(), PATH)
    out = steps[0]()(batch)
    assert out.column(out.schema.get_field_index("agrees")).to_pylist() == [False]
    right = len(pieces.processor(PATH).encode("some words of text"))
    assert out.column(1).to_pylist() == [right]  # one id less, and the end
    pieces.digests(Frame(), PATH, strict=True)
    with pytest.raises(ValueError):
        steps[1]()(batch)
    common._KEPT.clear()
