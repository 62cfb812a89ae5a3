"""The audit against brute force, order by order: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import re

import pytest

from inkwell.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, digest string, good string, A int, `a.b` int"
WORDS = " ".join(f"w{i}" for i in range(150))


def rows():
    texts = [WORDS, WORDS, None, "", "SHORT SHOUT", "a | b", WORDS + " $", "same " * 200, WORDS.upper(), WORDS.upper() + " é漢字", "long one " * 40 + WORDS * 3, "x" * 300, WORDS + " %", "same " * 200, "\x1c".join("abc")]
    made = [(i, t, [None, "en", "de", ""][i % 4]) for i, t in enumerate(texts)]
    made += [(3, WORDS, "en"), (3, WORDS, "en"), (None, WORDS, "fr"), (None, "only here", "fr"), (40, WORDS, "fr")]
    return [(*r, "p", "d", "g", 1, 2) for r in made]


LABELS = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (2, 1, None), (3, 1, 1), (4, None, None), (6, 1, 1), (None, 1, 1), (8, 0, 1), (13, 1, 0), (99, 1, 1), (40, 1, 0)]


def brute(table, labels):
    failing, out = [], []
    for doc, text, lang in (r[:3] for r in table):
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, *_ in table) else set()
        marks = [any(d == doc and d is not None and x[i] == 1 for d, *x in labels) for i in (0, 1)]
        failing.append((lang or "", fails, *marks))
    for part in {f[0] for f in failing}:
        mine = [f[1:] for f in failing if f[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            for i, f in enumerate(order):
                before, gone = set(order[:i]), [m for m in mine if f in m[0] and not m[0] & set(order[:i])]
                removed_by[f] += len(gone)
                steps.append([part, "".join(order), i + 1, sum(not m[0] & (before | {f}) for m in mine), len(gone), sum(f in m[0] and bool(m[0] & before) for m in mine), sum(m[0] == {f} for m in mine), sum(m[1] for m in gone), sum(m[2] for m in gone)])
        out += [(*s, removed_by[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("block", [1 << 17, 3])
def test_audit(spark, monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK_ROWS", block)
    monkeypatch.setattr(filter_audit, "WORD_BYTES", 50)
    table = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(table, labels).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute(rows(), LABELS)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert filter_audit.audit(spark.createDataFrame(rows()[:2], SCHEMA), labels).count() == 2 * 600


def test_own_filters_and_many_parts(spark):
    """Two filters and one label of a caller's, with more parts than a task holds counts of."""
    table = spark.range(9000).selectExpr("cast(id % 4500 AS string) AS `odd part`", "id % 2 = 0 AS x", "id % 3 = 0 AS y", "if(id % 5 = 0, true, null) AS mark")
    index = filter_audit.bitmaps(table, ["x", "y"], ["mark"], "odd part")
    counts = filter_audit.survivors(index, 2, 1)
    total = counts.groupBy("subset").sum("kept", "kept_0").collect()
    want = {0: [i for i in range(9000)], 1: [i for i in range(9000) if i % 2], 2: [i for i in range(9000) if i % 3], 3: [i for i in range(9000) if i % 2 and i % 3]}
    assert {r[0]: (r[1], r[2]) for r in total} == {k: (len(v), sum(i % 5 == 0 for i in v)) for k, v in want.items()}
    steps = filter_audit.interactions(counts, "XY", ["mark"])
    assert steps.count() == 4500 * 4 and steps.selectExpr("sum(shapley)").first()[0] == 2 * 2 * (9000 - len(want[3]))
    with pytest.raises(ValueError):
        filter_audit.interactions(counts, "ABCDEFGHI", [])


def test_word_counts(monkeypatch):
    monkeypatch.setattr(filter_audit, "WORD_BYTES", 4)
    for text in (b"", b" ", b"a", b"aaaaaaaaaa b a", b"\ta  bb\x0b\x0cccc aaaaaa\r\nbb ", "é漢 é x ".encode() * 9):
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text) if w]
        assert filter_audit.word_counts(text) == (len(words), len(set(words)))
