"""Personal data: base spans against Python's re, added spans against spans that are known."""

import hashlib
import random
import re

import pytest

from inkwell.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def passes(kind, hit):
    n = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    return {"email": True, "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in BASE.items()}


def texts():
    rng = random.Random(3)
    bits = ["a.b@c.org", "x@y", "@", "a@b.c.d", "..", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "01.002.3.255", "+49 (30) 123-4567", "+1", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", " ", "  ", "-", "é", "漢字", "😀", "\n", "12345678901234567890123", "5", "+4 5.6(7)8 9 0 1 2 3", "token", ",", "0" * 16]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    return [None, "", *made, "9" * 20000, "a" * 50000 + "@b.c", "1." * 10000, "x 4111 1111 1111 1111 y " * 3000]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        spans = base_spans(text)
        line = ",".join(f"{kind}:{a}:{b}" for kind in BASE for a, b in spans[kind])
        assert [got[k][f"n_{kind}"] for kind in BASE] == [len(spans[kind]) for kind in BASE]
        assert got[k].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(got[k].spans.split(","))


def test_added_spans(spark):
    """Examples that the trees haven't seen: nearly all spans are found, look-alikes are left unless a base pattern has them."""
    known = pii.examples(1500, seed=77)
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame([x[:2] for x in known], "doc_id long, text string")).collect()}
    hit = wrong = spans = alike = 0
    for number, text, kind, start, end in known:
        found = [s.split(":") for s in got[number].split(",") if s]
        base = {(k, a, b) for k, v in base_spans(text).items() for a, b in v}
        if kind:
            spans, hit = spans + 1, hit + any(int(a) <= start + 1 and int(b) >= end - 1 for _, a, b in found)
        else:
            alike, wrong = alike + 1, wrong + any((k, int(a), int(b)) not in base for k, a, b in found)
    assert hit >= 0.95 * spans and wrong <= 0.03 * alike


#: Sentences written by hand, with what is to be redacted in brackets.
BY_HAND = (
    "Please write to [anna.meier (at) firma (dot) de] before noon.",
    "our old address was [jsmith [at] example.org], it bounces now",
    "Dial [(212) 555-0187] and ask for the night desk.",
    "phone: [0171/5559283], evenings only",
    "the box answers on [2001:0db8:85a3:0000:0000:8a2e:0370:7334] again",
    'password = "[Tr0ub4dor&3xyz]"',
    "export API_KEY=[sk-9fK2mQ7xLw0ZbV4tYc8RdJ1e]",
    "Authorization: [d41d8cd98f00b204e9800998ecf8427e]",
    "Transfer the deposit to [DE89 3704 0044 0532 0130 00] by Friday.",
    "Her SSN [219-09-9999] was on the form.",
    "account no. [4929173300518264] is overdrawn",
    "Konto [532013000] bei der Sparkasse",
    "Paid with [4539.1488.0343.6467] last week.",
    "token: [eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9]",
    "The sum of 1219538112535716 and 9807915762804490 is not a card.",
    "It ran for 86400 seconds on 2023-11-05 at 14:25:59.",
    "See chapter 12, pages 340-355, ISBN 978-3-16-148410-0.",
    "Release 10.4.2 fixes issue 20481 in module io_utils_test_helpers.",
    "Population rose from 1,204,331 to 1,350,009 within 15 years.",
    "The score was 3:2:1 in sets, 120 minutes in all.",
    "build 20240117 of the tool lives in /usr/local/share/toolkit/bin",
    "Donaudampfschifffahrtsgesellschaftskapitaen is one word.",
    "================ SECTION FOUR ================",
    "order 10023344 shipped, tracking to follow",
    "the key: patience",
    "pi is about 3.14159265358979 and e 2.718281828",
)


def test_by_hand(spark):
    rows = [(k, t.replace("[at]", "\0").replace("[", "").replace("]", "").replace("\0", "[at]")) for k, t in enumerate(BY_HAND)]
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong, missed = [], []
    for k, text in rows:
        marked = re.search(r"\[(?!at\])(.*)\]", BY_HAND[k])
        want = text.find(marked[1]) if marked else -1
        covered = [a <= want + 1 and b >= want + len(marked[1]) - 1 for a, b in got[k]] if marked else []
        missed += [text] if marked and not any(covered) else []
        wrong += [(text, text[a:b]) for a, b in got[k] if not marked or b <= want or a >= want + len(marked[1])]
    assert not missed and not wrong


def test_thresholds_are_finite(spark):
    model = pii.fit(spark)
    assert len(model["least"]) == len(pii.WIDE) and all(abs(x) < 50 for x in model["least"])
    assert model == pii.fit(spark)


def test_redact(spark):
    text = 'mail a.b@c.org, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" or 10.0.0.1'
    rows = [(1, text, "s"), (1, text, None), (2, None, "t"), (3, "", "u"), (4, "plain words", "v")]
    table = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    clean = pii.redact(table)
    got = sorted(map(tuple, clean.collect()), key=str)
    want = 'mail [EMAIL], token = "[SECRET]" or [IP]'
    assert clean.columns == table.columns and got == sorted([(1, want, "s"), (1, want, None), *rows[2:]], key=str)


@pytest.mark.parametrize("f", [pii.find, pii.redact])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "doc_id long, text string, spans string")).count() == 0
