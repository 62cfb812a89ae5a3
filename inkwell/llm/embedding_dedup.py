"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by fast Hadamard transforms with random signs; the axis that it then lies nearest to, with its sign,
is a hash. Two or more of them make a bucket of one of some tables, and a vector also probes the buckets got by taking
the second nearest axis in one of them. With the rows grow the hashes of a bucket, so that it keeps `LOAD` vectors about, and
with the hashes the tables, so that pairs are found as surely (SHAPES). Within a bucket all pairs are verified by their cosine in double precision. A
pair counts in the first bucket that its vectors share, so a bucket sends only each vector's number of links and one tie
to its component, never pairs. Buckets above `BLOCK` vectors are split in blocks that meet two at a time.

Equal vectors are folded into one with a weight first, so a very common vector is one row. Null and zero vectors and those
with null or non-finite components link with nothing, nor do vectors of different lengths. Rows that repeat a vec_id
count each for itself; a null vec_id is never a component's name unless all its members' are null. An empty table gives an
empty result. Columns other than vec_id and embedding don't take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, tidied, written
from .components import components
from .hashing import mixed

COSINE = 0.9
#: Tables by hashes of a bucket: at a cosine of 0.9 these find over 0.99 of pairs in 64 and in 384 dimensions (measured on 1500 random pairs).
SHAPES = {2: 8, 3: 24, 4: 48}
#: Vectors that unrelated rows leave in a bucket, at most, before it is made of more hashes.
LOAD = 32
BLOCK = 1024
#: Rows hashed at a time.
ROWS = 512
#: Pairs whose first shared bucket is sought at a time.
PAIRS = 1 << 16


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised Walsh-Hadamard transform of the last axis; additions only, so that a vector's result doesn't depend on its batch."""
    d, step = x.shape[-1], 1
    while step < d:
        y = x.reshape(*x.shape[:-1], d // (2 * step), 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x


def hashes_for(rows: int, dim: int) -> int:
    """Hashes of a bucket for a table of so many rows."""
    axes = 2 << max(dim - 1, 0).bit_length()
    return next((h for h in SHAPES if rows <= LOAD * axes**h), max(SHAPES))


def codes(x: np.ndarray, hashes: int = min(SHAPES)) -> np.ndarray:
    """Buckets of each row of x: shape (rows, tables, 1 + hashes), the home bucket first."""
    n, dim = x.shape
    tables, wide = SHAPES[hashes], 1 << max(dim - 1, 0).bit_length()
    signs = np.random.default_rng(dim).choice([-1.0, 1.0], (3, tables * hashes, wide))
    y = np.zeros((n, 1, wide))
    y[:, 0, :dim] = x / np.abs(x).max(axis=1, keepdims=True)
    for s in signs:
        y = _hadamard(y * s)
    size = np.abs(y)
    first = size.argmax(axis=2)
    at = np.indices(first.shape)
    size[at[0], at[1], first] = -1
    second = size.argmax(axis=2)
    axis = lambda i: (2 * i + (y[at[0], at[1], i] < 0)).reshape(n, tables, hashes)
    one, two = axis(first), axis(second)
    out = np.empty((n, tables, 1 + hashes), np.uint64)
    for probe in range(1 + hashes):
        code = np.full((n, tables), dim, np.uint64) * np.uint64(1000) + np.arange(tables, dtype=np.uint64)
        for h in range(hashes):
            code = code * np.uint64(2 * wide) + (two if probe == h + 1 else one)[:, :, h].astype(np.uint64)
        out[:, :, probe] = code
    return mixed(out).view(np.int64)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _spread(batches: Iterator[pa.RecordBatch], rows_in_all: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for each of its buckets."""
    for batch in batches:
        lengths = np.diff(batch.column(2).offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            some = batch.take(pa.array(np.flatnonzero(lengths == dim)))
            for a in range(0, some.num_rows, ROWS):
                part = some.slice(a, ROWS)
                buckets = codes(_matrix(part.column(2)), hashes_for(rows_in_all, dim)).reshape(part.num_rows, -1)
                own = [np.unique(b) for b in buckets]
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(b) for b in own]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), *part.take(rows).columns], names=["bucket", *part.schema.names])


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of code blocks the first shared bucket: by table, then the least."""
    same = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    table = same.any(axis=2).argmax(axis=1)
    at = np.arange(len(a))
    return np.where(same[at, table], a[at, table], np.iinfo(np.int64).max).min(axis=1)


def _cell(rows_in_all: int, bucket: int, left: int, right: int, ids: np.ndarray, weight: np.ndarray, block: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch | None:
    """Of the vectors of two blocks of a bucket (or of one): links first met here, and a tie to the component. None without links."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= COSINE
    np.fill_diagonal(near, False)
    if left != right:
        near &= block[:, None] != block[None, :]
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return None
    ids, weight, vectors, near = ids[some], weight[some], vectors[some], near[np.ix_(some, some)]
    links = np.zeros(len(ids), np.int64)
    i, j = np.nonzero(np.triu(near))
    own = codes(vectors, hashes_for(rows_in_all, vectors.shape[1]))
    for k in range(0, len(i), PAIRS):
        p, q = i[k : k + PAIRS], j[k : k + PAIRS]
        here = _first_shared(own[p], own[q]) == bucket
        np.add.at(links, p[here], weight[q[here]])
        np.add.at(links, q[here], weight[p[here]])
    label, low = np.arange(len(ids)), None
    while low is None or (low != label).any():
        label = low if low is not None else label
        low = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
        low = low[low]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[label])], names=["id", "links", "tie"])


def _verify(batches: Iterator[pa.RecordBatch], rows_in_all: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive cell by cell."""
    kept: list[pa.RecordBatch] = []
    now = None

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        if t.num_rows > 1:
            found = _cell(rows_in_all, *now, *(t.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5)), _matrix(t.column(6)))
            if found is not None:
                yield found

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)], 1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            key = tuple(keys[a].tolist())
            if key != now and kept:
                yield from flush()
                kept.clear()
            now = key
            kept.append(batch.slice(a, b - a))
    if kept:
        yield from flush()


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding)."""
    e = F.col("embedding")
    finite = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding", F.coalesce(finite, F.lit(False)).alias("good"))
    good = rows.filter("good").select("vec_id", "embedding", F.xxhash64("embedding").alias("id"), F.xxhash64(F.lit(1), "embedding").alias("check"))
    # Equal vectors are one, known by a number of its own; two hashes tell which.
    found = good.groupBy(F.col("id").alias("hash"), "check").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    folded = written(found.withColumn("id", F.monotonically_increasing_id()))
    n = folded.count()
    spread = folded.select("id", "weight", "embedding").mapInArrow(tidied(lambda b: _spread(b, n)), f"bucket long, id long, weight long, embedding {folded.schema['embedding'].dataType.simpleString()}")
    big = written(spread.groupBy("bucket").count().filter(F.col("count") > BLOCK))
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    dealt = spread.join(big, "bucket", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = dealt.select("bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "id", "weight", "block", "embedding")
    cells = cells.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    found = written(cells.mapInArrow(tidied(lambda b: _verify(b, n)), "id long, links long, tie long").groupBy("id", "tie").agg(F.sum("links").alias("links")))
    labels = components(found.select(F.col("id").alias("a"), F.col("tie").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = folded.select("id", "hash", "check", "vec_id", "weight").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").join(links, "id", "left")
    known = written(known.select("id", "hash", "check", "vec_id", "weight", F.coalesce("label", "id").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    names = known.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    each = known.join(names, "label").select("hash", "check", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    twice = (F.when(F.col("good"), h).alias(n) for n, h in (("hash", F.xxhash64("embedding")), ("check", F.xxhash64(F.lit(1), "embedding"))))
    out = rows.select("vec_id", *twice).join(written(each), ["hash", "check"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: What the search finds where it misses no pair.
SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good
  FROM embeddings),
g AS MATERIALIZED (SELECT r, v, len(v) AS n FROM d WHERE good),
links AS MATERIALIZED (SELECT x.r AS a, y.r AS b FROM g AS x JOIN g AS y ON x.n = y.n AND x.r <> y.r WHERE CASE WHEN x.n = y.n THEN list_cosine_similarity(x.v, y.v) >= 0.9 END),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS r, min(vec_id) AS vec_id FROM reach JOIN d ON d.r = reach.b GROUP BY a),
told AS (SELECT d.vec_id, coalesce(degree.n, 0) AS n_links, least(d.vec_id, named.vec_id) AS component_id FROM d LEFT JOIN degree USING (r) LEFT JOIN named USING (r))
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM told
"""

shipped(__name__)
