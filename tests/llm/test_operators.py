"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import re

import numpy as np
import pytest

from inkwell.llm import embedding_dedup, exact_dedup, ngram_jaccard, packing, piece_codec, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, hash string"
WORDS = [f"w{i}" for i in range(400)]


def rows():
    rng = np.random.default_rng(3)
    base = list(rng.choice(WORDS, 120))
    near = [*base[:60], "other", *base[61:]]
    texts = {1: " ".join(base), 2: " ".join(base), 3: "\n".join(base), 4: " ".join(near), 5: None, 6: "", 7: " \t\n", 8: "one two", 9: "One TWO", 10: " ".join(rng.choice(WORDS, 20000)), 11: "mail a.b@c.org or 10.0.0.1, +49 30 1234567 and 4111 1111 1111 1111", 12: "x é漢字 ▁ 😀"}
    return [(k, t, None, "s", 1, "a", "b") for k, t in texts.items()] + [(1, texts[1], None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_exact_dedup(docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.verdicts(docs).collect()}
    assert {(1, 1, 4, True), (2, 1, 4, False), (3, 1, 4, False), (5, 7, 3, False), (6, 7, 3, False), (7, 7, 3, True)} <= got
    kept = exact_dedup.dedupe(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 8, 9, 10, 11, 12]


def test_ngram_jaccard(docs):
    jaccard_is_right(docs)


def test_ngram_jaccard_with_shared_ids(docs, monkeypatch):
    """Ids of two bits: nearly all of them are shared by different sets, which have to be told apart."""
    whole = ngram_jaccard.set_ids
    monkeypatch.setattr(ngram_jaccard, "set_ids", lambda hashes, ends: whole(hashes, ends) & 3)
    jaccard_is_right(docs)
    assert sorted(r.doc_id for r in ngram_jaccard.one_of_each(docs).collect()) == [1, 5, 6, 7, 8, 10, 11, 12]
    monkeypatch.setattr(ngram_jaccard, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        ngram_jaccard.join(docs)


def jaccard_is_right(docs):
    sets, texts = {}, {r[0]: r[1] for r in rows()}
    for k, t in texts.items():
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.join(docs).collect()} == {(k, len(s), label[k]) for k, s in sets.items()}


def test_substring(docs):
    count, words = collections.Counter(), [(r[0], split(r[1])) for r in rows()]
    for _, w in words:
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for k, w in words:
        gone = {i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}
        want.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(want) == sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect())


def test_codec_and_packing(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    for r in piece_codec.digests(docs).collect():
        ids = sp.encode({x[0]: x[1] for x in rows()}[r.doc_id] or "")
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    pieces = packing.pack(docs).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert (pieces.groupby("doc_id").length.sum() >= 1).all() and set(pieces.doc_id) == set(range(1, 13))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 16))
    x[10:20] = x[9] + rng.normal(size=(10, 16)) * 0.1
    x[30] = x[9]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [1.0, None])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(60)])
    assert (found <= degree).all() and found.sum() >= 0.9 * degree.sum() and got[30].component_id == 9
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103))


@pytest.mark.parametrize("f", [exact_dedup.verdicts, ngram_jaccard.join, substring.remove_repeats, piece_codec.digests, packing.pack], ids=lambda f: f.__module__)
def test_empty(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0
