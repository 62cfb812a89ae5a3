"""The line join in DataFrame operations against brute force; no Python in its plans, and no row a pair of a crowd."""

import random

import pytest

from inkwell.llm import line_dedup, line_join

from .test_line_dedup import brute, lines


@pytest.mark.parametrize(("seed", "n_docs", "longest", "n_base", "percent"), [(7, 300, 24, 60, 75), (8, 160, 220, 40, 75), (10, 120, 200, 5, 75), (11, 120, 30, 20, 60)])
def test_removed(spark, seed, n_docs, longest, n_base, percent):
    docs = lines(seed, n_docs, longest, n_base)
    docs.append((9003, "Été é É\nété É é x\nÉTÉ é É\na\tb\x0bc\x0cd\r\n A  b c d "))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.line, r.removed) for r in line_join.removed(table, percent).collect()), key=str)
    assert got == brute(docs, percent)


def test_crowd_makes_a_row_an_entry(spark, monkeypatch):
    """Lines of one core and different further words, most of them similar to none: no table holds more rows than entries, and none is made in Python."""
    rng = random.Random(3)
    core = [f"common{i}" for i in range(30)]
    docs = [(d, " ".join(core + [f"own{d}x{i}" for i in range(rng.randint(1, 30))])) for d in range(250)]
    made, plans, keep = [], [], line_join.stored

    def kept(df):
        plans.append(df._jdf.queryExecution().toString())
        made.append(keep(df))
        return made[-1]

    monkeypatch.setattr(line_join, "stored", kept)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    table.write.mode("overwrite").parquet(path := line_join_folder(spark))
    got = line_join.removed(spark.read.parquet(path), 75)
    assert sorted(((r.doc_id, r.line, r.removed) for r in got.collect()), key=str) == brute(docs)
    entries = sum(n - -(-75 * n // 100) + 1 for n in (len(text.split()) for _, text in docs))
    assert all(t.count() <= entries for t in made[1:] if "line" in t.columns and "set" not in t.columns)
    assert plans and not any(x in plan for plan in plans for x in ("InArrow", "ArrowEvalPython", "InPandas"))
    summary = line_dedup.summary(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert not any(x in summary for x in ("InArrow", "ArrowEvalPython", "InPandas"))


def test_a_common_word_makes_no_entries(spark, monkeypatch):
    """Lines that share a long word of their prefix, and copies, but no two similar sets: none is compared with another."""
    docs = [(d, "uncommonlycommon " + " ".join(f"own{d}x{i}" for i in range(3 + d % 9))) for d in range(200)]
    docs += [(d + 200, docs[d][1]) for d in range(40)]
    met, keep = [], line_join._gone
    monkeypatch.setattr(line_join, "_gone", lambda docs, entries, percent: met.append(entries.count()) or keep(docs, entries, percent))
    got = line_join.removed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 75)
    assert sorted(((r.doc_id, r.line, r.removed) for r in got.collect()), key=str) == brute(docs)
    assert met == [0]


def test_letters_beyond_ascii(spark):
    """A-Z alone are lowered, also beside letters whose first bytes are letters of Latin-1."""
    letters = ["\u00c0", "\u00e0", "\u00c9", "\u00e9", "\u00df", "\u1e9e", "\u0178", "\u00ff", "\u00d7", "\u212a", "k", "\u0130", "\u3040", "\u00e3", "\u00c3", "\U0001f600", "\u00b5", "\u00a0", "\u0085"]
    docs = [(d, f"A{x}B {x} C\tD\r") for d, x in enumerate(letters)] + [(d + 50, f"a{x}b {x}\x0bc\x0cd") for d, x in enumerate(letters)]
    got = line_join.removed(spark.createDataFrame(docs, "doc_id long, text string"), 75)
    assert sorted(((r.doc_id, r.line, r.removed) for r in got.collect()), key=str) == brute(docs)


def line_join_folder(spark):
    from inkwell.llm.common import scratch

    return scratch(spark)
