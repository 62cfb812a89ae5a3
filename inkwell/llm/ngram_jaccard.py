"""N-gram Jaccard join over count-vector R-trees.

A document's set holds its distinct shingles of `N` words (fewer words: the whole sequence as one; none: empty), A-Z in
lower case. Sets link where 100 * intersection >= percent * union. Equal sets are one; the rest goes in these steps.

1. Order. Documents travel in chunks, and each chunk asks the blocks of the hash space how many chunks have each of its
   shingles. Shingles are ordered by that number, then by hash, so that what is common comes last.
2. Deal. Linked sets share one of their first n - ceil(percent * n / 100) + 1 shingles. Those that stand in another set
   too are the cells within which sets are compared; a set with enough shingles of its own has none.
3. Points. A set is a point of `GROUPS` coordinates: how many of its shingles hash to each group. The summed minima of
   two points bound their overlap, as do their sizes and the shared shingle's place in the order.
4. Stars. In each cell all sets are tried against two pivots, the least and the greatest by hash. Pairs whose points,
   here of `FINE` coordinates, allow a link are verified by their texts. So a group of thousands of near copies is joined
   by a few pairs for each member.
5. R-trees. Cells whose sets lie in more than one component by then index their points in an R-tree (blocks of `BLOCK`
   sets meet two at a time); searches with the bounds, and the finer points, give the pairs still open,
   which are verified like the stars. After that no pair that could link two components is left.

An R-tree over all points at once would prune next to nothing, as unrelated texts have much the same counts, hence step 2.
Null texts count as empty; empty sets link with nothing. Rows that repeat a text, or a doc_id, each get a row. Sets are
known by ids of 64 bits and told apart by 64 more: ids that different sets share are found and those sets given others, so
that 128 bits have to agree by chance. Texts may have any length. An empty table gives an empty result. Further columns don't take part; `one_of_each` keeps them whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import one_row_each, plain_names, rows_of, shipped, tidied, written
from .components import components
from .hashing import Runs, Words, distinct, mixed
from .substring import chunked

N = 5
PERCENT = 75
GROUPS = 8
BLOCK = 1024
LEAF = 32
#: Coordinates of the finer points, by which pairs are judged before their texts are fetched.
FINE = 256
#: A set carries its least cell shingles, so that a pair can be left to the least cell that both are seen to share.
LOWS = 8
#: What makes a set's check differ from its id.
CHECK = np.uint64(0xA5A5A5A55A5A5A5A)
#: Rounds of finding ids that different sets share. Sets that the first leaves are so few that a second is hardly ever needed.
MAX_ROUNDS = 8
#: In cells of so many sets the pivots meet all others.
COVERED = 3


def shingles(text: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in ascending order, one after another, and where each row's begin and end."""
    words = Words(text, lower=True)
    runs, rows = Runs(words.hashes()), words.row_ends
    count = np.diff(rows)
    some = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(some)])
    starts = np.arange(ends[-1]) - np.repeat(ends[:-1] - rows[:-1], some)
    hashes = runs.of(starts, np.repeat(np.minimum(count, n), some))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        hashes[a:b].sort()
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    first[ends[:-1][some > 0]] = True
    upto = np.concatenate([[0], np.cumsum(first)])
    return hashes[first], upto[ends]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[ends[1:]] - total[ends[:-1]]


def set_ids(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed(_sums(mixed(hashes), ends) + np.diff(ends).astype(np.uint64)).view(np.int64)


def checks(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each set that don't depend on its id's."""
    return mixed(_sums(mixed(hashes ^ CHECK), ends) + np.diff(ends).astype(np.uint64)).view(np.int64)


def told_apart(sid: np.ndarray, check: np.ndarray, clashes: list[np.ndarray]) -> np.ndarray:
    """The ids; those that different sets share, by rounds, made anew from id and check."""
    for shared in clashes:
        anew = mixed(mixed(sid.view(np.uint64)) + check.view(np.uint64)).view(np.int64)
        sid = np.where(np.isin(sid, shared), anew, sid)
    return sid


def _unit(size: np.ndarray) -> np.ndarray:
    """A coordinate's unit for sets of a size, so that it fits in a byte."""
    return np.int64(1) << np.maximum(np.frexp(size.astype(np.float64))[1] - 8, 0).astype(np.int64)


def points(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A long of GROUPS bytes for each row: counts in units of _unit(n), rounded up."""
    size = np.diff(ends)
    unit = _unit(size)
    out = np.zeros(len(size), np.uint64)
    for g in range(GROUPS):
        count = _sums((hashes % np.uint64(GROUPS) == g).astype(np.int64), ends)
        out |= (-(-count // unit)).astype(np.uint64) << np.uint64(8 * g)
    return out.view(np.int64)


def _fine(hashes: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """FINE bytes for each of the rows: counts by other bits of the hash, in units of _unit(n), rounded up."""
    out = np.empty((len(rows), FINE), np.uint8)
    unit = _unit(np.diff(ends))
    for k, i in enumerate(rows.tolist()):
        count = np.bincount((hashes[ends[i] : ends[i + 1]] >> np.uint64(8)).astype(np.uint8), minlength=FINE)
        out[k] = -(-count // unit[i])
    return out


def _coordinates(point: np.ndarray, size: np.ndarray) -> np.ndarray:
    return ((point.view(np.uint64)[:, None] >> (np.arange(GROUPS, dtype=np.uint64) * np.uint64(8))) & np.uint64(255)).astype(np.int64) * _unit(size)[:, None]


#: A row for each document (doc_id, digest, n, sid, check), for each set with cells (near: sid, n, fine, size, packed) and for each of its cells.
SIGNED = "kind string, doc_id long, digest binary, sid long, check long, n int, token long, place int, point long, fine binary, lows binary, size long, packed binary"


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size - -(-percent * size // 100) + 1, 0)


def _chunk(row: dict, n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A chunk's texts with their shingles."""
    whole = pa.decompress(row["texts"], decompressed_size=row["size"], codec="zstd", asbytes=True) if row["size"] else b""
    at = np.concatenate([[0], np.frombuffer(row["ends"], np.int64)])
    texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(whole))
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], *shingles(texts, n)


def _ask(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        _, hashes, _ = _chunk(row, n)
        yield blocks.sent_short(row["chunk"], distinct(blocks.short(hashes, bits)), bits)


def _sign(batches: Iterator[pa.RecordBatch], n: int, percent: int, bits: int, clashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows as in SIGNED of each chunk; rank: how common a shingle is, by the chunks that have it, or by sets if one has. clashes: as in told_apart."""
    kinds = dict(x.split() for x in SIGNED.split(", "))
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def told(kind: str, count: int, **columns) -> pa.RecordBatch:
        columns["kind"] = [kind] * count
        return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(count, types[t]) for c, t in kinds.items()], names=list(kinds))

    for row in rows_of(batches):
        texts, hashes, ends = _chunk(row, n)
        size, check, point = np.diff(ends), checks(hashes, ends), points(hashes, ends)
        sid = told_apart(set_ids(hashes, ends), check, clashes)
        yield told("doc", len(size), doc_id=row["ids"], digest=[hashlib.md5(t).digest() for t in texts], n=size.astype(np.int32), sid=sid, check=check)
        _, once = np.unique(sid, return_index=True)
        once = once[size[once] > 0]
        first = np.zeros(len(size), bool)
        first[once] = True
        _, back = np.unique(blocks.short(hashes, bits), return_inverse=True)
        local = np.bincount(back, weights=np.repeat(first, size)).astype(np.int64) if len(back) else back
        chunks = blocks.levels(row["answers"]).astype(np.int64)
        rank = np.where(chunks > 1, 8 + chunks, np.minimum(local, 8))[back].astype(np.uint64)
        order, take = (rank << np.uint64(58)) | (hashes >> np.uint64(6)), _prefix(size, percent).tolist()
        tokens, places, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], []
        for i in once.tolist():
            a, b = ends[i], ends[i + 1]
            lead = np.argsort(order[a:b], kind="stable")[: take[i]]
            some = np.flatnonzero(rank[a:b][lead] > 1)
            if len(some):
                tokens.append(hashes[a:b][lead[some]])
                places.append(some.astype(np.int32))
                rows.append(i)
        if rows:
            rows = np.array(rows)
            of = np.repeat(rows, [len(t) for t in tokens[1:]])
            yield told("cell", len(of), sid=sid[of], n=size[of].astype(np.int32), token=np.concatenate(tokens).view(np.int64), place=np.concatenate(places), point=point[of])
            fine = _fine(hashes, ends, rows)
            packed = [pa.compress(texts[i], codec="zstd", asbytes=True) for i in rows.tolist()]
            lows = [np.pad(np.sort(t)[:LOWS], (0, max(0, LOWS - len(t))), constant_values=~np.uint64(0)).tobytes() for t in tokens[1:]]
            yield told("near", len(rows), sid=sid[rows], n=size[rows].astype(np.int32), lows=lows, fine=[f.tobytes() for f in fine], size=[len(texts[i]) for i in rows.tolist()], packed=packed)


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs whose finer points allow a link."""
    for batch in batches:
        size = [batch.column(c).to_numpy().astype(np.int64) for c in (2, 4)]
        fine = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in (3, 5)]
        same = np.minimum(*(f * _unit(n)[:, None] for f, n in zip(fine, size, strict=True))).sum(axis=1)
        near = pa.array((100 + percent) * same >= percent * (size[0] + size[1]))
        yield batch.filter(near).select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """a, b of the pairs that link; in: a, b and both texts."""
    kept: dict = {}

    def of(sid: int, size: int, packed: bytes) -> np.ndarray:
        if sid not in kept:
            if len(kept) >= 64:
                kept.clear()
            text = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
            kept[sid] = shingles(pa.array([text.decode()], pa.large_string()), n)[0]
        return kept[sid]

    for batch in batches:
        found = []
        for r in batch.to_pylist():
            x, y = of(r["a"], r["size_a"], r["packed_a"]), of(r["b"], r["size_b"], r["packed_b"])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                found.append((r["a"], r["b"]))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class RTree:
    """Sort-tile-recursive packing of points; a node knows its points' greatest counts and least and greatest size."""

    def __init__(self, counts: np.ndarray, size: np.ndarray):
        self.counts, self.size = counts, size
        order = self._tiled(np.arange(len(size)), 0)
        self.order, self.levels = order, []
        top, low, high = counts[order], size[order], size[order]
        while True:
            cuts = np.arange(0, len(low), LEAF)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))
            if len(low) == 1:
                break

    def _tiled(self, rows: np.ndarray, axis: int) -> np.ndarray:
        """By size, in tiles of that by the first count, and so on."""
        if len(rows) <= LEAF or axis > GROUPS:
            return rows
        key = self.size[rows] if axis == 0 else self.counts[rows, axis - 1]
        rows = rows[np.argsort(key, kind="stable")]
        tiles = max(2, round((len(rows) / LEAF) ** (1 / 3)))
        step = -(-len(rows) // (tiles * LEAF)) * LEAF
        return np.concatenate([self._tiled(rows[a : a + step], axis + 1) for a in range(0, len(rows), step)])

    def search(self, counts: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose bounds allow a link with this point."""

        def open_(top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            near = (100 * high >= percent * size) & (100 * size >= percent * low)
            return near & ((100 + percent) * np.minimum(top, counts).sum(axis=1) >= percent * (np.maximum(low, -(-percent * size // 100)) + size))

        nodes = np.zeros(1, np.int64)
        for top, low, high in reversed(self.levels):
            nodes = nodes[nodes < len(low)]
            nodes = nodes[open_(top[nodes], low[nodes], high[nodes])]
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = self.order[nodes[nodes < len(self.order)]]
        return rows[open_(self.counts[rows], self.size[rows], self.size[rows])]


def _open_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that the bounds allow, cell by cell; rows: token, left, right, block, sid, n, place, point, label, fine, lows."""

    def cell(t: pa.Table) -> pa.RecordBatch:
        """Few sets are a single leaf and need no tree."""
        block, sid, size, place, point, label = (t.column(c).to_numpy() for c in ("block", "sid", "n", "place", "point", "label"))
        size, place = size.astype(np.int64), place.astype(np.int64)
        one = t.column("left")[0].as_py() == t.column("right")[0].as_py()
        counts, found = _coordinates(point, size), []
        fine = np.frombuffer(b"".join(t.column("fine").to_pylist()), np.uint8).reshape(-1, FINE) * _unit(size)[:, None].astype(np.int32)

        token = np.int64(t.column("token")[0].as_py()).view(np.uint64)
        lows = np.frombuffer(b"".join(t.column("lows").to_pylist()), np.uint64).reshape(-1, LOWS)

        def elsewhere(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Whether a smaller shingle than this cell's is among the least of both: that one's cell has the pair too."""
            both = (lows[p][:, :, None] == lows[q][:, None, :]).any(axis=2)
            return (both & (lows[p] < token)).any(axis=1)

        def told(p: np.ndarray, q: np.ndarray) -> None:
            """Pairs of rows p and q that pass the bounds on counts and places."""
            p, q = (x[label[p] != label[q]] for x in (p, q))
            p, q = (x[~elsewhere(p, q)] for x in (p, q))
            need = percent * (size[p] + size[q])
            fits = (100 + percent) * np.minimum(fine[p], fine[q]).sum(axis=1) >= need
            fits &= (100 + percent) * (np.minimum(place[p], place[q]) + np.minimum(size[p] - place[p], size[q] - place[q])) >= need
            found.append(np.stack([np.minimum(sid[p], sid[q]), np.maximum(sid[p], sid[q])], 1)[fits])

        if one and len(sid) <= LEAF:
            told(*np.triu_indices(len(sid), 1))
        else:
            inside = np.arange(len(sid)) if one else np.flatnonzero(block == t.column("left")[0].as_py())
            asking = inside if one else np.flatnonzero(block != t.column("left")[0].as_py())
            tree = RTree(counts[inside], size[inside]) if len(inside) else None
            for q in asking.tolist() if tree else []:
                hit = inside[tree.search(counts[q], int(size[q]), percent)]
                told(hit, np.full(len(hit), q))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    kept: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2)], 1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            if tuple(keys[a].tolist()) != now and kept:
                yield cell(pa.Table.from_batches(kept))
                kept = []
            now = tuple(keys[a].tolist())
            kept.append(batch.slice(a, b - a))
    if kept:
        yield cell(pa.Table.from_batches(kept))


def members(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, digest (MD5 of the text), n, sid (set) of each row of docs (doc_id, text); sid, label of the sets with links; sid, least doc_id of the sets."""
    chunks = chunked(docs)
    bits = blocks.bits_for(chunks.count())
    answers = blocks.counted(chunks.mapInArrow(tidied(lambda b: _ask(b, n, bits)), blocks.SENT))
    answered, clashes = chunks.join(answers, "chunk", "left"), []
    for _ in range(MAX_ROUNDS):
        signed = written(answered.mapInArrow(tidied(lambda b: _sign(b, n, percent, bits, clashes)), SIGNED), by="kind")
        shared = signed.filter("kind = 'doc'").groupBy("sid").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low < high")
        # By chance n sets share about n*n / 2**65 ids: 3 of 10**10 sets, 27,000 of 10**12.
        clash = np.array([r.sid for r in shared.select("sid").collect()], np.int64)
        if not len(clash):
            break
        clashes = [*clashes, clash]
    else:
        raise RuntimeError(f"different sets still share ids after {MAX_ROUNDS} rounds")
    narrow = signed.filter("kind = 'doc'").select("doc_id", "digest", F.col("n").cast("long").alias("n"), "sid")
    cells = signed.filter("kind = 'cell'").select("token", "sid", "n", "place", "point")
    near = signed.filter("kind = 'near'").select("sid", "n", "fine", "lows", "size", "packed")
    pivots = written(cells.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count("*").alias("rows")).filter("low < high"))
    tried = cells.select("token", "sid").join(pivots, "token").select("sid", F.explode(F.array("low", "high")).alias("pivot")).filter("sid != pivot")
    stars = written(tried.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct())
    first = narrow.groupBy("sid").agg(F.min("doc_id").alias("doc_id"))

    def verified(pairs: DataFrame, judged: bool) -> DataFrame:
        """Those that link; judged: their finer points are known to allow it."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        sets = written(near.join(written(ends), "sid", "left_semi").dropDuplicates(["sid"]))
        if not judged:
            end = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("fine").alias(f"fine_{s}"))
            both = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "fine_a", "n_b", "fine_b")
            pairs = written(both.mapInArrow(tidied(lambda b: _close(b, percent)), "a long, b long"))
        packed = sets.select("sid", "size", "packed")
        side = lambda s: packed.select(F.col("sid").alias(s), F.col("size").alias(f"size_{s}"), F.col("packed").alias(f"packed_{s}"))
        return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidied(lambda b: _verify(b, n, percent)), "a long, b long"))

    links = verified(stars, False)
    labels = components(links)
    wide = cells.join(pivots.filter(f"rows > {COVERED}").select("token"), "token")
    told = wide.join(written(labels).withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    told = written(told.select("token", "sid", "n", "place", "point", "label"))
    mixed_cells = told.groupBy("token").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    open_cells = told.join(written(mixed_cells.select("token", "rows")), "token")
    points_of = near.select("sid", "fine", "lows").join(written(open_cells.select("sid").distinct()), "sid", "left_semi").dropDuplicates(["sid"])
    open_cells = open_cells.join(written(points_of), "sid")
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    dealt = open_cells.withColumn("block", F.pmod(F.xxhash64("sid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "sid", "n", "place", "point", "label", "fine", "lows")
    # A fixed number: by their bytes these rows would be gathered in few tasks, though each is much work.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "token", "left", "right").sortWithinPartitions("token", "left", "right")
    more = dealt.mapInArrow(tidied(lambda b: _open_pairs(b, percent)), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    more = written(more)
    if not more.isEmpty():
        labels = components(links.unionByName(verified(more, True)))
    return narrow, written(labels.withColumnRenamed("node", "sid")), first


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    narrow, labels, first = members(docs, n, percent)
    # Sets first, rows last: a set of many rows is one row of these joins.
    names = labels.join(first, "sid").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    each = written(labels.join(names, "label").select("sid", "component_id"))
    out = narrow.join(first.select("sid", F.col("doc_id").alias("own_id")), "sid", "left").join(each, "sid", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "own_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


@plain_names("doc_id", "text")
def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component, that with the least doc_id (null last), then the least digest of its text. Rows without words stay."""
    narrow, labels, _ = members(docs, n, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    # Two steps, the first within sets, so that a component of many rows is few rows of the second.
    sets = narrow.filter("n > 0").groupBy("sid").agg(F.min(rank).alias("best"), F.count("*").alias("rows"))
    sets = written(sets.join(labels, "sid", "left").select("sid", F.coalesce("label", "sid").alias("label"), "best", "rows"))
    groups = sets.groupBy("label").agg(F.min("best").alias("chosen"), F.sum("rows").alias("rows")).filter("rows > 1")
    chosen = written(sets.join(groups.select("label", "chosen"), "label").select("sid", "chosen"))
    told = narrow.join(chosen, "sid").groupBy("doc_id", "digest").agg(F.max(rank == F.col("chosen")).alias("stays"), F.count("*").alias("rows"))
    told = told.filter("NOT stays OR rows > 1").select("doc_id", "digest", "stays")
    return one_row_each(docs, F.unhex(F.md5(F.coalesce("text", F.lit("")))), written(told))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
w AS (SELECT r, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d),
runs AS (SELECT r, place, n, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM w),
s AS MATERIALIZED (SELECT DISTINCT r, shingle FROM runs WHERE place <= greatest(n - 4, 1)),
size AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS n FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN size AS p ON p.r = a JOIN size AS q ON q.r = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS r, min(doc_id) AS doc_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least(d.doc_id, named.doc_id) AS component_id FROM d LEFT JOIN size USING (r) LEFT JOIN named USING (r)
"""

shipped(__name__)
