"""The trie against brute force: nulls, ties, repeated turns, hot conversations over many parts, members' digests in pieces, empty tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import conversation_trie, scans

SCHEMA = "conv_id long, turn long, role string, text string, depth int, digest string, `a.b` int"


def brute(table):
    turns = collections.defaultdict(list)
    for conv, turn, role, text, *_ in table:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, key, (role, text)))
    turns = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    again = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = collections.defaultdict(list)
    for c, t in again.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    own = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in members.items()}
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own[p]
    ends = {p: ",".join(map(str, sorted(c for c in m if len(again[c]) == len(p)))) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def rows(seed):
    rng = np.random.default_rng(seed)
    made = []
    for c in range(120):
        for turn in range(int(rng.integers(0, 14))):
            made.append((int(c), turn if rng.random() > 0.1 else None, ["user", None, "é", ""][rng.integers(0, 4)] if turn > 2 else "user", ["hello", None, "", "grüße 漢字", "x" * 300][rng.integers(0, 1 + min(turn, 4))]))
    made += [(200, t, "user", f"turn {t % 3}") for t in range(400)] + [(201, 0, "user", "hello")] * 3  # a long one; one of repeated rows
    made += [(c, t, "user", "copy") for c in range(300, 340) for t in range(6)] + [(None, 1, "user", "nobody"), (-7, 0, "user", "hello"), (-7, 1, None, None)]
    return [(*m, 9, "z", 1) for m in made]


@pytest.mark.parametrize(("seed", "piece", "parts"), [(1, 1 << 14, 4), (2, 3, 11)])
def test_trie(spark, monkeypatch, seed, piece, parts):
    monkeypatch.setattr(conversation_trie, "PIECE", piece)
    monkeypatch.setattr(scans, "PART_ROWS", 60)
    table = rows(seed)
    got = found(conversation_trie.trie(spark.createDataFrame(table, SCHEMA).repartition(parts)))
    key = lambda r: (r[1], r[0])
    assert sorted(got, key=key) == sorted(brute(table), key=key)


def test_small_tables(spark):
    assert conversation_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "", 1)], SCHEMA)).count() == 0
    one = [(3, 0, None, None, 1, "", 1)]
    assert found(conversation_trie.trie(spark.createDataFrame(one, SCHEMA))) == brute(one)


def test_running_sums_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(scans, "PART_ROWS", 50)
    table = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 40).cast("long").alias("g"), "id", (F.col("id") % 5).alias("x"))
    local = lambda columns, heads: {"total": scans.sums(columns["x"].to_numpy(), heads)}
    out = scans.running(table, ["g"], [F.col("id")], ["total"], local, lambda carry, values: {"total": values["total"] + carry["total"]}).collect()
    upto, want = collections.Counter(), {}
    for i in range(3000):
        g = 7 if i < 2000 else i % 40
        upto[g] += i % 5
        want[i] = upto[g]
    assert {r.id: r.total for r in out} == want
