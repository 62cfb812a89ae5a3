"""Quality: held-out accuracy, and what happens without labels, with one class, and on odd rows."""

import zlib

import numpy as np
import pytest

from inkwell.llm import quality

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all() and (got.predicted == (got.score >= 0.3)).all()
    known = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = (known.score[known.quality == k].to_numpy() for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() >= 0.97


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality.F.when(quality.fold() == 0, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    one, two = (quality.classify(docs, x).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, turned))
    assert np.array_equal(one, two)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i} and more of it", "s", 0.5) for i in range(40)] + [(None, "x", None, None), (50, None, None, None), (51, "", None, None), (1, "other", None, None), (52, "long " * 200_000, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double")


def test_without_labels(docs, spark):
    got = quality.classify(docs, spark.createDataFrame([(1, None, 0), (999, 1, 0)], LABELS)).collect()
    assert len(got) == 45 and all(abs(r.score - 0.5) < 1e-9 and r.predicted == 1 for r in got)
    assert quality.accepted(docs, spark.createDataFrame([], LABELS)).count() == 45


@pytest.mark.parametrize("label", [0, 1])
def test_one_class(docs, spark, label):
    got = quality.classify(docs, spark.createDataFrame([(i, label, 0) for i in range(40)], LABELS)).collect()
    assert {r.predicted for r in got} == {label} and len({r.score for r in got}) == 1


def test_clashes_ties_and_bounds(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 2 + [(1, 0, 0)], LABELS)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    rows, n = quality.training_rows(docs, labels, 10)
    assert n == rows.count() == rows.select("doc_id").distinct().count() and n < 25


def test_empty(spark):
    empty, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1, 0)], LABELS)
    assert quality.classify(empty, labels).count() == 0 and quality.accepted(empty, labels).count() == 0
