"""op1's added kinds: IBANs by country, social security numbers, overlaps, redaction, many spans."""

import random
import time

import pytest

from loomcrawl.llm import pii


def iban(country, rng):
    body = "".join(rng.choice("0123456789ABCXYZ") for _ in range(pii.IBAN_LENGTH[country] - 4))
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{98 - rest:02d}{body}"


@pytest.mark.parametrize("country", sorted(pii.IBAN_LENGTH))
def test_iban_of_every_country(country):
    rng = random.Random(country)
    x = iban(country, rng)
    spaced = " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    for form in (x, spaced):
        for before, after in (("", ""), ("iban ", " PLEASE PAY now"), ("(", ")"), ("to ", " AND 12 MORE"), ("x: ", ". End")):
            got = [(k, e - s) for k, s, e, _ in pii.find(f"{before}{form}{after}") if k == "iban"]
            assert got == [("iban", len(form))], (before, form, after)
    wrong = x[:-1] + ("1" if x[-1] != "1" else "2")
    assert not [s for s in pii.find(f"iban {wrong}") if s[0] == "iban"]
    assert not [s for s in pii.find(f"iban {x}7") if s[0] == "iban"] and not [s for s in pii.find(f"A{x}") if s[0] == "iban"]


def test_iban_before_capitals():
    for t in ("DE89370400440532013000 PLEASE PAY now", "iban DE89 3704 0044 0532 0130 00 AND pay"):
        assert "iban" in {k for k, _, _, _ in pii.find(t)}


def test_ssn_numbers():
    ok = lambda t: [t[s:e] for k, s, e, _ in pii.find(t) if k == "ssn"]
    assert ok("ssn 123-45-6789") == ["123-45-6789"]
    for x in ("000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "123-45-67890", "123-45-6789-1"):
        assert ok(f"ssn {x}") == []
    assert ok("part 123-45-6789") == []


def test_added_spans_keep_clear_of_base_ones():
    rng = random.Random(1)
    pieces = ["card 4111 1111 1111 1111", "amex 378282246310005", "ssn 123-45-6789", "+49 30 1234567", "DE89370400440532013000", "a.b@c.de", "10.0.0.1", "word"]
    for _ in range(300):
        t = rng.choice(["", " ", ", "]).join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        found = pii.find(t)
        base = [(s, e) for k, s, e, _ in found if k in pii.BASE]
        added = [(s, e) for k, s, e, _ in found if k not in pii.BASE]
        assert all(e <= a or s >= b for s, e in added for a, b in base)
        clean = pii.redact(t, found)
        assert all(t[s:e] not in clean for k, s, e, _ in found if k == "iban")


def test_many_spans_in_linear_time():
    t = "ssn 123-45-6789 a.b@c.de 10.0.0.1 " * 20_000
    at = time.process_time()
    found = pii.find(t)
    assert len(found) == 60_000 and time.process_time() - at < 20


@pytest.mark.parametrize("odd", ["+" * 50_000, "1-" * 50_000, "@" * 50_000, "a@" * 50_000, "+1(" * 40_000, "DE89" * 30_000, "1." * 50_000, "a.b" * 50_000 + "@"], ids=range(8))
def test_odd_long_texts(odd):
    at = time.process_time()
    pii.find(odd)
    assert time.process_time() - at < 10
