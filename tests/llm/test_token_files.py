"""Token files: exact round trips against the tokenizers library, codes of every width, order, parts, nulls, repeated rows, clashing columns."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkwell.llm import token_files
from inkwell.llm.common import scratch

SCHEMA = "doc_id long, text string, part int, ids string, `a.b` int"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_codes(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> (8 * rng.integers(0, 4, n, dtype=np.uint64))).astype(np.uint32)
    ranks[:3] = [255, 256, (1 << 32) - 1][: len(ranks[:3])]
    control, data = token_files.packed(ranks)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
    assert token_files.unpacked(control, data, n).tolist() == ranks.tolist()


def rows():
    texts = ["Some words, here! and THERE.", None, "", "<|startoftext|> x <|endoftext|>", "漢字 é 😀 " * 50, "word " * 9000, "tab\tand\nline"]
    made = [((i * 5) % 11 - 3, t) for i, t in enumerate(texts * 4)]
    return [(d, t, 7, "x", 1) for d, t in [*made, (None, "nobody's"), (None, None), (2, "twin"), (2, "twin")]]


@pytest.mark.parametrize("least", [1 << 22, 500])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(token_files, "LEAST_TOKENS", least)
    tokenizer, path = Tokenizer.from_file(token_files.default_tokenizer()), scratch(spark)
    token_files.write(spark.createDataFrame(rows(), SCHEMA).repartition(3), path, block_tokens=300)
    want = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in rows()]
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in got[:2]] == [True, True] and [r.doc_id for r in got[2:]] == sorted(d for d, _ in want if d is not None)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    key = lambda d, ids: (d is not None, d or 0, ids)
    assert sorted(key(r.doc_id, r.ids) for r in got) == sorted(key(d, ids) for d, ids in want)
    sums = {(r.start, r.n_tokens, r.ids_crc32) for r in token_files.checksums(spark, path).collect()}
    assert sums == {(r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert all(a.n > b.n or a.n == b.n and a.id < b.id for a, b in zip(ranks, ranks[1:])) and sum(r.n for r in ranks) == sum(len(i) for _, i in want)
    blocks = token_files.blocks(spark, path).collect()
    assert all(sum(b.lengths) <= 300 or len(b.lengths) == 1 for b in blocks) and (len({b.part for b in blocks}) > 1) == (least == 500)


def test_empty(spark):
    path = scratch(spark)
    token_files.write(spark.createDataFrame([], SCHEMA), path)
    assert token_files.checksums(spark, path).count() == 0 == token_files.read(spark, path).count()
