"""Line dedup against brute force: mutated lines, long ones, crowds, repeated and null ids."""

import random
import re

import pytest

from inkwell.llm import line_dedup


def lines(seed, n_docs, longest, n_base):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, longest))] for _ in range(n_base)]

    def mutated(w):
        w = list(w)
        for _ in range(rng.randint(0, 1 + len(w) // 7)):
            k, i = rng.random(), rng.randrange(len(w))
            if k < 0.4:
                w[i] = rng.choice(words)
            elif k < 0.7 and len(w) > 1:
                del w[i]
            else:
                w.insert(i, rng.choice(words))
        rng.shuffle(w)
        return " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()

    docs = [(d, "\n".join(mutated(rng.choice(base)) if rng.random() < 0.9 else " \t" for _ in range(rng.randint(0, 6)))) for d in range(n_docs)]
    docs += [(9000, None), (9001, ""), (None, "x y z\nx y z q r"), (5, docs[3][1]), (9002, "\n\n")]
    rng.shuffle(docs)
    return docs


def brute(docs, percent=75):
    found = []
    for d, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            words = frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)) if x)
            if words:
                found.append(((-1 if d is None else d, i), words))
    gone = [any(q < p and 100 * len(s & t) >= percent * len(s | t) for q, t in found) for p, s in found]
    return sorted(((None if p[0] < 0 else p[0], p[1], g) for (p, _), g in zip(found, gone, strict=True)), key=str)


@pytest.mark.parametrize(("seed", "n_docs", "longest", "n_base", "options"), [(7, 300, 24, 60, {}), (8, 160, 220, 40, {}), (9, 300, 24, 6, {"crowd": 4, "best": 1}), (10, 120, 200, 5, {"crowd": 2, "best": 2})])
def test_marks(spark, seed, n_docs, longest, n_base, options):
    docs = lines(seed, n_docs, longest, n_base)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.line, r.removed) for r in line_dedup.marks(table, **options).collect()), key=str)
    assert got == brute(docs)


def test_other_percent(spark):
    docs = lines(11, 120, 30, 20)
    got = sorted(((r.doc_id, r.line, r.removed) for r in line_dedup.marks(spark.createDataFrame(docs, "doc_id long, text string"), 60).collect()), key=str)
    assert got == brute(docs, 60)


def test_more_lines_than_a_group_holds(spark):
    text = "\n".join(f"a{i % 40000} b{i % 40000}" for i in range(80000))
    got = line_dedup.summary(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_lines, got.n_removed) == (80000, 40000)


def test_summary_and_clean(spark):
    rows = [(1, "a b c d\nx", "s"), (2, "A b c D\n\ny z", "t"), (3, "a b c e d", None), (4, None, "u"), (None, "x", "v")]
    table = spark.createDataFrame(rows, "doc_id long, text string, line string")
    assert {(r.doc_id, r.removed) for r in line_dedup.summary(table).collect()} == {(None, ""), (1, "1"), (2, "0"), (3, "0"), (4, "")}
    clean = line_dedup.clean(table)
    assert clean.columns == table.columns and {r.doc_id: (r.text, r.line) for r in clean.collect()}[2] == ("\ny z", "t")


def test_empty(spark):
    table = spark.createDataFrame([], "doc_id long, text string, mark long")
    assert line_dedup.summary(table).count() == 0 and line_dedup.clean(table).columns == table.columns


def test_pairs_once_over_blocks(spark, monkeypatch):
    """In the second turn lines that share words of many blocks make one pair, and none is lost."""
    docs, met = lines(12, 300, 24, 6), []
    keep = line_dedup._met
    monkeypatch.setattr(line_dedup, "bits_for", lambda n: 5)
    monkeypatch.setattr(line_dedup, "_met", lambda *args: met.append(keep(*args)) or met[-1])
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.line, r.removed) for r in line_dedup.marks(table, crowd=4, best=1).collect()), key=str)
    assert got == brute(docs) and len(met) == 2
    assert met[1].count() == met[1].select("a", "b").distinct().count() > 100
