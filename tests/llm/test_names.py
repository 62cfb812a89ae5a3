"""Columns of any name go through every operator that keeps them, untouched; foreign arrivals stay; ids that look alike."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import embedding_dedup, exact_dedup, line_dedup, ngram_jaccard, pii, piece_codec, quality, sharding
from inkwell.llm.common import scratch

ODD = ["a.b", "x`y", "__pii_base", "pii_base", "pii_wide", "__gone", "inkwell_c0", "Text", "digest", "ids.x", "keep id"]
WORDS = " ".join(f"w{i}" for i in range(40))
TEXTS = [WORDS, WORDS, WORDS + " more", "mail a@b.org now", None, "", "one\ntwo two\none\n" + WORDS, "x" * 30000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *(f"{c}{i}" for c in ODD)) for i, t in enumerate(TEXTS)]
    plain = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"k{i} string" for i in range(len(ODD)))]))
    return plain.toDF("doc_id", "text", *ODD).repartition(3)


def check(out, kept):
    """The columns are those of docs, with what they held, and these rows are left."""
    assert out.columns[: 2 + len(ODD)] == ["doc_id", "text", *ODD]
    rows = out.collect()
    assert sorted(r[0] for r in rows) == kept
    assert all(r[2 + i] == f"{c}{r[0]}" for r in rows for i, c in enumerate(ODD))
    return {r[0]: r for r in rows}


def test_names(spark, docs):
    everything = list(range(len(TEXTS)))
    assert check(pii.redact(docs), everything)[3][1] == "mail [EMAIL] now"
    check(line_dedup.clean(docs), everything)
    check(exact_dedup.dedupe(docs), [0, 2, 3, 4, 6, 7])
    check(ngram_jaccard.one_of_each(docs), [0, 3, 4, 5, 7])
    check(quality.accepted(docs, spark.createDataFrame([], "doc_id long, quality int")), everything)
    encoded = piece_codec.encode(docs)
    got = check(encoded, everything)
    assert encoded.columns[-2:] == ["ids", "decoded"] and got[3][-1] == TEXTS[3] and got[4][-2] == []
    assert {r[0]: r[-1] for r in piece_codec.decode(encoded).collect()} == {i: r[-1] for i, r in got.items()}


def test_foreign_arrivals(spark):
    """Rows whose arrival is null or outside stay, in the last version; without arrivals there is that one alone."""
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for n, first in ((3, 2), (0, 0)):
        store = sharding.ShardStore.create(spark, scratch(spark), table.schema)
        arrival = F.when(F.col("doc_id") < 6, F.col("doc_id") - 1)
        assert store.append_arrivals(table, arrival, n) == n + 1
        want = collections.Counter((i, t) for i, t in enumerate(TEXTS))
        assert collections.Counter((r[0], r[1]) for r in store.read().collect()) == want
        assert {r.doc_id for r in store.read(n).collect()} == set(range(1, n + 1)) and first <= n
    assert store.append_arrivals(table.limit(0), F.lit(0), 0) == 1


def test_object_stores_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ATOMIC", ("hdfs",))
    with pytest.raises(ValueError, match="isn't one step"):
        sharding.ShardStore.create(spark, scratch(spark), spark.range(1).schema)


def test_equal_and_unnamed_vectors(spark):
    """Rows that repeat a vector, a vec_id or both, or have no vec_id."""
    a, b, c = [1.0, 0.0, 0.2, 0.1], [1.0, 0.0, 0.2, 0.15], [0.0, 1.0, 0.0, 0.0]
    rows = [(3, a), (3, a), (None, a), (2, b), (5, c), (5, [0.0, 0.0, 1.0, 0.0]), (None, None), (9, [1.0])]
    got = collections.Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == collections.Counter([(3, 3, 2, False), (3, 3, 2, False), (None, 3, 2, False), (2, 3, 2, True), (5, 0, 5, True), (5, 0, 5, True), (None, 0, None, True), (9, 0, 9, True)])


@pytest.mark.parametrize("load", [0.01, 0.001])
def test_more_hashes(spark, monkeypatch, load):
    """Buckets of three and four hashes, as for tables too large for a test: links and classes against brute force."""
    monkeypatch.setattr(embedding_dedup, "LOAD", load)
    assert embedding_dedup.hashes_for(300, 32) == (3 if load == 0.01 else 4) and embedding_dedup.hashes_for(0, 32) == 2
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))
    x[100:200] = x[:100] + rng.normal(size=(100, 32)) * rng.uniform(0.1, 0.5, (100, 1))
    x[200:240] = x[7] + rng.normal(size=(40, 32)) * 0.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    degree, links = near.sum(1) - 1, np.array([got[i].n_links for i in range(300)])
    assert (links <= degree).all() and links.sum() >= 0.97 * degree.sum() > 1000
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(near, label[None], 300).min(1))
    assert np.mean([got[i].component_id == label[i] and got[i].kept == (label[i] == i) for i in range(300)]) > 0.97
