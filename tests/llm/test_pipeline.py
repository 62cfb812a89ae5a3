"""The pipeline stage by stage against brute force, each stage judged on what it was given."""

import collections
import re

import pytest

from inkwell.llm import packing, pii, quality
from inkwell.llm.common import written

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, names = docs, [name for name, _ in pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "ngram_jaccard", "pii", "packing"]
    outputs = {}
    for name, stage in pipeline.STAGES:
        given = outputs[name] = written(stage(spark, given, SF))
        if name != "packing":
            assert given.columns == docs.columns
    texts = [rows(docs), *(rows(outputs[n]) for n in names[:4])]

    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert texts[1] == {k: t for k, t in texts[0].items() if scores[k] >= quality.CUT} and 0 < len(texts[1]) < len(texts[0])

    groups = collections.defaultdict(list)
    for k, t in texts[1].items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), k))
    assert texts[2] == {k: texts[1][k] for _, k in map(min, groups.values())} and len(texts[2]) < len(texts[1])

    sets = {k: shingles(t) for k, t in texts[2].items()}
    label = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = a < b and len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert texts[3] == {k: t for k, t in texts[2].items() if label[k] == k} and len(texts[3]) < len(texts[2])

    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.find(spark.createDataFrame(list(texts[3].items()), "doc_id long, text string")).collect()}
    for k, t in texts[3].items():
        want, at = "", 0
        for kind, a, b in sorted(((kind, int(a), int(b)) for kind, a, b in spans[k]), key=lambda s: (s[1], s[2], pii.KINDS.index(s[0]))):
            if a >= at:
                want += t[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert texts[4][k] == (want + t[at:] if spans[k] else t)
    assert any(spans.values())

    pieces = outputs["packing"].collect()
    lengths = collections.Counter()
    for p in pieces:
        lengths[p.doc_id] += p.length
    assert set(lengths) == set(texts[4]) and all(lengths[p.doc_id] == p.doc_tokens for p in pieces)
    sizes = collections.Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
    assert max(sizes.values()) <= packing.CAPACITY


def test_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, clashing columns; then no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, digest string"
    text = " ".join(f"w{i}" for i in range(80))
    table = [(1, text, "x", "s", 1, "a", "b"), (1, text, None, None, None, None, None), (None, text + " z", None, None, None, "c", None), (2, None, None, None, None, None, "d"), (3, "", None, None, None, None, None)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(table, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert {r.doc_id for r in pipeline.run(spark, f"file://{tmp_path}").collect()} == {1, 2}
    empty = spark.createDataFrame([], schema)
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, empty, f"file://{tmp_path}")
        assert out.columns == empty.columns and out.count() == 0, name
    assert pipeline.STAGES[4][1](spark, empty, f"file://{tmp_path}").count() == 0
