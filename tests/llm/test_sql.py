"""Queries against their SQL in DuckDB, on small tables of odd rows and, where links are to be found, copies."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from inkwell.llm import queries

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def answer(con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)


def folder(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return con


def texts():
    rng = np.random.default_rng(8)
    words = [*(f"w{i}" for i in range(300)), "é", "漢字", "W5", "w5.", "\u3000x", "a\u00a0b"]
    base = [list(rng.choice(words, n)) for n in (3, 5, 34, 35, 36, 80, 200, 3000)]
    made = [" ".join(b) for b in base] + [" \t".join(b) + "\n" for b in base]
    for b in base[2:]:  # near copies, parts within other texts, and the same words twice
        made += [" ".join([*b[:20], "new", *b[21:]]), " ".join(["x", *b[:60], "y"]), " ".join([*b, *b]).upper(), " ".join([*b, "z", *b])]
    made += ["", " \r\n", None, None, "one", "One", "a b c d e", "A B C D E", "a b c d e f", "same " * 40, "same " * 36, "\x0b\x0c tab"]
    return [(None if i in (2, 18) else i // 2 if 30 < i < 34 else i, t, "x") for i, t in enumerate(made)]


@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op9_substring_dedup"])
def test_texts(spark, tmp_path, name):
    con = folder(spark, tmp_path, "documents", texts(), "doc_id long, text string, run string")
    got = rows_of(queries.QUERIES[name](spark, str(tmp_path)))
    assert len(got) == len(texts()) and got == answer(con, queries.ORACLE_SQL[name])


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 32))
    x[10:20] = x[9] + rng.normal(size=(10, 32)) * 0.15  # cosines of 0.95 and more
    x[30:33] = x[40]
    rows = [(None if i in (12, 50) else 7 if i == 70 else i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(100, None, "x"), (101, [0.0] * 32, "x"), (102, [float("nan")] * 32, "x"), (103, [1.0, None], "x"), (104, [float("inf"), 1.0], "x"), (105, [], "x"), (106, [1.0, 2.0], "x"), (107, [2.0, 4.0], "x")]
    con = folder(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>, id string")
    got = rows_of(queries.op8_embedding_dedup(spark, str(tmp_path)))
    assert sum(r[2] for r in got) > 90 and got == answer(con, queries.ORACLE_SQL["op8_embedding_dedup"])  # columns by name: n_links is third


@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op8_embedding_dedup", "op9_substring_dedup"])
def test_given_tables(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows_of(queries.QUERIES[name](spark, SF)) == answer(con, queries.ORACLE_SQL[name])
