"""Repeated and null ids, clashing columns, digests in full, and word hashes."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import embedding_dedup, exact_dedup, hashing, ngram_jaccard, packing, piece_codec, substring
from inkwell.llm.blocks import bits_for, sent, sent_short, short

A = " ".join(f"w{i}" for i in range(60))
CLASH = "doc_id long, text string, of string, sha string, digest string, stays string, keep_id long, label string, sid long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "of", "sha", "d", "s", 1, "l", k) for k, (i, t) in enumerate(rows)], CLASH).repartition(3)


def left(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_one_of_each(spark):
    rows = [(1, A), (5, A + " z"), (5, "some other text of its own"), (None, A + " y"), (None, "alone here with no number"), (7, None), (8, ""), (None, " "), (9, "few words"), (9, "few words"), (10, "few words")]
    kept = ngram_jaccard.one_of_each(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert left(kept) == collections.Counter([(1, A), (5, "some other text of its own"), (None, "alone here with no number"), (7, None), (8, ""), (None, " "), (9, "few words")])


def test_one_of_each_without_ids(spark):
    assert sum(left(ngram_jaccard.one_of_each(table(spark, [(None, A), (None, A), (None, A + " q")]))).values()) == 1


def test_dedupe(spark):
    rows = [(1, "a b"), (2, "ab"), (2, "other"), (None, "a  b"), (3, None), (4, ""), (5, "twin"), (5, "twin"), (None, "x"), (None, "x")]
    kept = exact_dedup.dedupe(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert left(kept) == collections.Counter([(None, "a  b"), (2, "other"), (3, None), (5, "twin"), (None, "x")])


def test_fingerprint_blocks(spark):
    prints = spark.createDataFrame([(x,) for x in [*range(-50, 50), 2**63 - 1, -(2**63), 7, 7, -7, 2**63 - 1]], "fp long")
    assert {(r.fp, r.n) for r in exact_dedup.repeated_fingerprints(prints).collect()} == {(7, 3), (-7, 2), (2**63 - 1, 2)}


def test_pieces_in_full(spark):
    from tokenizers import Tokenizer

    texts = {1: A * 40, 2: None, 3: "", 4: "Short. Text! With? ends; and, <|x|> marks.", 5: "漢字 é 😀 " * 300, 6: "no end " * 900}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    pieces = packing.pack(docs).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert len(part) == p.length > 0 and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    for k, mine in by_doc.items():
        ends = [(p.start, p.start + p.length) for p in sorted(mine, key=lambda p: p.start)]
        assert ends[0][0] == 0 and ends[-1][1] == len(ids[k]) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    for mine in by_sequence.values():
        at = 0
        for p in sorted(mine, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY


def test_codec_in_full(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    texts = [None, "", "  two  blanks ", "tab\tand\nline", "▁▁", "漢字 é 😀", "ﬁne Ⅳ ｆｕｌｌ", "x" * 5000, A * 100, "\u0000 odd ​"]
    got = piece_codec.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


@pytest.mark.parametrize("size", [64, 384])
def test_embedding_recall(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(400, size))
    for i in range(0, 200, 2):  # pairs from just below to well above the threshold
        other = rng.normal(size=size)
        cosine = 0.88 + 0.12 * i / 200
        unit = x[i] / np.linalg.norm(x[i])
        other -= (other @ unit) * unit
        x[i + 1] = cosine * unit + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = (unit @ unit.T >= 0.9).sum(1) - 1
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()}
    found = np.array([got[i].n_links for i in range(400)])
    assert (found <= degree).all() and found.sum() >= 0.9 * degree.sum() > 100
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_word_hashes():
    """Equal words have equal hashes wherever they stand, and only these."""
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("ab"), n)) for n in rng.integers(1, 30, 4000)] + ["a" * n for n in (7, 8, 9, 15, 16, 17, 511, 512, 513, 900)]
    texts = [" ".join(made[::-1]), "\t".join(made), "", " "]
    words = hashing.Words(pa.array(texts, pa.large_string()))
    seen = {}
    for h, w in zip(words.hashes().tolist(), made[::-1] + made, strict=True):
        assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(made)) and len(hashing.Words(pa.array(["", " "], pa.large_string())).hashes()) == 0


def test_blocks():
    assert [bits_for(n) for n in (0, 1, 17, 1 << 20, 1 << 40)] == [4, 4, 5, 20, 30]
    hashes = np.unique(np.random.default_rng(2).integers(0, 2**64, 500, np.uint64))
    rows = sent(3, hashes, 6).to_pylist()
    assert np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows]).tolist() == hashes.tolist()
    assert all((np.frombuffer(r["hashes"], np.uint64) >> np.uint64(58) == r["block"]).all() for r in rows)
    known = np.unique(short(hashes, 6))
    assert sum(len(r["hashes"]) for r in sent_short(3, known, 6).to_pylist()) == 4 * len(known)
    assert sent(1, np.zeros(0, np.uint64), 6).num_rows == 0


def test_substring_levels(spark):
    """Windows of other lengths, with several doublings, against brute force."""
    rng = np.random.default_rng(8)
    words = [[f"v{i}" for i in rng.integers(0, 3, n)] for n in rng.integers(0, 60, 40)]
    for window in (3, 35, 50):
        count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
        want = {k: len({i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}) for k, w in enumerate(words)}
        got = substring.remove_repeats(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "doc_id long, text string"), window)
        assert {r.doc_id: r.n_removed for r in got.collect()} == want


def test_words_of_texts():
    text = "a b \x0b\x0cc d\x1ce"
    words = hashing.Words(pa.array([text], pa.large_string()))
    assert len(words.starts) == len([w for w in re.split(r"[\x20\x09-\x0D]+", text) if w])
