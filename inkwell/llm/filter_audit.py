"""Filter interaction audit over a packed bitmap index.

Each partition packs its rows into blocks of bitmaps: per part one bitset for every filter (set where the row fails it)
and every label. For each subset of the filters, as it can precede a step, the survivors are the part's rows AND NOT the
union of the subset's bitsets, and a popcount gives how many there are, and how many of them bear a label. Partitions'
counts are summed; every figure of every order follows from the 2**k sums of a part, so rows are read once, not once an order.

`failures` applies the five text filters:
A under 100 words; B distinct words under 80 % of the words; C capitals A-Z over 10 % of the code points; D holds any of
`#$%&*|`; E the same text (by SHA-256 of its UTF-8 bytes) stands at a smaller doc_id. Words are maximal runs of
`[^\\x20\\x09-\\x0D]`. Null text counts as empty, a null part as the empty string. A row with a null doc_id never fails E and
makes no other row fail it; rows that repeat a doc_id don't fail E by each other. Labels that are null, or of unknown documents,
say nothing; of several labels of a document the greatest counts, and all rows of the document bear it. Texts may have any
length: the words of a long one are counted in blocks. An empty table has no parts and gives no rows. Only the columns that
are named are read, whatever else the tables hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, slices, small_batches, tidied, written
from .hashing import raw

FILTERS = "ABCDE"
#: Rows of a block of bitmaps.
BLOCK_ROWS = 1 << 17
#: Bytes of a text whose words are held at a time.
WORD_BYTES = 1 << 20
#: The orders of more filters than this would be too many rows.
MOST_FILTERS = 8
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words; bytes.split() cuts at the same six blanks."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _BLANK.search(text, at + WORD_BYTES)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part and, for each of FILTERS, whether the row fails it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = np.zeros(256, bool)
        sign[list(b"#$%&*|")] = True
        for block in slices(batches):
            text = block.column(2)
            data, rows = raw(text)
            whole = data.tobytes()
            each = [whole[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
            words, distinct = np.array([word_counts(t) for t in each], np.int64).T
            held = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[rows])
            points = pc.utf8_length(text).to_numpy()
            fails = [words < 100, 100 * distinct < 80 * words, 100 * held((data >= 65) & (data <= 90)) > 10 * points, held(sign[data]) > 0]
            digests = pa.array([hashlib.sha256(t).digest() for t in each], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *map(pa.array, fails), digests], names=["doc_id", "part", *"ABCD", "digest"])

    texts = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    told = written(texts.mapInArrow(tidied(run), "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"))
    first = told.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = told.join(first.select("digest", "first"), "digest", "left")
    return copies.select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good (quality is 1) and toxic (toxic is 1) from labels (doc_id, quality, toxic)."""
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = told.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    joined = rows.join(marks, "doc_id", "left")
    return joined.select(*rows.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def bitmaps(rows: DataFrame, filters: list[str], labels: list[str], part: str = "part") -> DataFrame:
    """The index: for each block of a partition and each part in it, n rows and a bitset for each of the boolean columns."""
    k = len(filters)

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        codes = pc.dictionary_encode(table.column(0).combine_chunks())
        of = codes.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(of, kind="stable")
        flags = np.array([table.column(1 + i).to_numpy() for i in range(table.num_columns - 1)]).astype(bool)[:, order]
        edges = np.searchsorted(of[order], np.arange(len(codes.dictionary) + 1)).tolist()
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        sets = [[b.tobytes() for b in np.packbits(flags[:, a:b], axis=1)] for a, b in spans]
        bits = pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays([codes.dictionary, pa.array([b - a for a, b in spans], pa.int64()), pa.array([s[:k] for s in sets], bits), pa.array([s[k:] for s in sets], bits)], names=["part", "n", "failing", "bearing"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    flags = [F.coalesce(F.col(f"`{c}`"), F.lit(False)) for c in (*filters, *labels)]
    plain = rows.select(F.col(f"`{part}`").alias("p"), *(f.alias(f"f{i}") for i, f in enumerate(flags)))
    return plain.mapInArrow(tidied(run), "part string, n long, failing array<binary>, bearing array<binary>")


def survivors(index: DataFrame, filters: int, labels: int) -> DataFrame:
    """part, subset (bit i for filter i), kept and kept_0, kept_1 ... : rows that no filter of the subset removes, and those of them with each label."""
    sums = ["kept", *(f"kept_{i}" for i in range(labels))]

    def counted(n: int, failing: list[bytes], bearing: list[bytes]) -> np.ndarray:
        bits = [np.frombuffer(x, np.uint8) for x in failing]
        rows = [np.packbits(np.ones(n, bool)), *(np.frombuffer(x, np.uint8) for x in bearing)]
        gone, out = [np.zeros_like(rows[0])], np.zeros((1 << filters, len(rows)), np.int64)
        for subset in range(1 << filters):
            if subset:
                low = (subset & -subset).bit_length() - 1
                gone.append(gone[subset & (subset - 1)] | bits[low])
            out[subset] = [np.bitwise_count(r & ~gone[subset]).sum() for r in rows]
        return out

    def given(parts: dict[str, np.ndarray]) -> pa.RecordBatch:
        table, names = np.concatenate(list(parts.values())), np.repeat(np.array(list(parts), object), 1 << filters)
        subset = np.tile(np.arange(1 << filters, dtype=np.int32), len(parts))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(subset), *(pa.array(c) for c in table.T)], names=["part", "subset", *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                parts[r["part"]] = parts.get(r["part"], 0) + counted(r["n"], r["failing"], r["bearing"])
            if len(parts) > 4096:
                yield given(parts)
                parts = {}
        if parts:
            yield given(parts)

    each = index.mapInArrow(tidied(run), "part string, subset int, " + ", ".join(f"{s} long" for s in sums))
    return each.groupBy("part", "subset").agg(*(F.sum(s).alias(s) for s in sums))


def interactions(counts: DataFrame, filters: str, labels: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step, from survivors().

    kept (after the step), removed (at it), redundant (failing its filter, removed before), unique_fails (failing no other filter), for each
    label <label>_lost (removed at it), and shapley (its filter's removed, summed over all orders).
    """
    k, names = len(filters), ["kept", *(f"kept_{i}" for i in range(len(labels)))]
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    full = (1 << k) - 1
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order):
            steps.append(f"struct('{''.join(filters[i] for i in order)}' AS o, {step + 1} AS step, {f} AS f, {1 << f} AS own, {before} AS before, {before | 1 << f} AS after)")
            before |= 1 << f

    def share(f: int) -> str:
        own = 1 << f
        return "+".join(f"{factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())}L*(s[{s}].kept-s[{s | own}].kept)" for s in range(full + 1) if not s & own)

    arrays = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", *names))).alias("s")).withColumn("share", F.expr(f"array({', '.join(map(share, range(k)))})"))
    at = arrays.select("part", "s", "share", F.explode(F.expr(f"array({', '.join(steps)})")).alias("x"))
    lost = (f"s[x.before].kept_{i} - s[x.after].kept_{i} AS {label}_lost" for i, label in enumerate(labels))
    removed = "s[x.before].kept - s[x.after].kept"
    return at.selectExpr("part", "x.o AS filter_order", "x.step AS step", "s[x.after].kept AS kept", f"{removed} AS removed", f"s[0].kept - s[x.own].kept - ({removed}) AS redundant", f"s[{full} - x.own].kept - s[{full}].kept AS unique_fails", *lost, "share[x.f] AS shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The five text filters in all 120 orders, for each part of docs."""
    index = bitmaps(labelled(failures(docs, part), labels), list(FILTERS), ["good", "toxic"])
    return interactions(written(survivors(index, len(FILTERS), 2)), FILTERS, ["good", "toxic"])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
b AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM b LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
i AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
j AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own FROM i),
k AS (SELECT *, CAST(sum(own) OVER (PARTITION BY filter_order ORDER BY step) AS BIGINT) - own AS earlier FROM j),
x AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & earlier > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, k GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x
"""

shipped(__name__)
