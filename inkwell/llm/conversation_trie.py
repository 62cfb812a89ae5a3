"""The prefix trie of conversations, with sums over its subtrees, by heavy-path decomposition.

Turns are put in order within their conversation and turned to digests; a prefix is known by its depth and the running sum of
digest times base**depth, twice in 64 bits with two bases, so prefixes of all depths come from one pass of running sums, whatever a
conversation's length. Nodes are the distinct prefixes. The largest child of a node (by members, then by the least conv_id)
is heavy and continues its path; every other child begins a path of its own, and as it has at most half of its parent's
members, at most log2 of the conversations' number such children lie above a node. Sums over a path's own nodes are
attached to the parent of its top, path by path from the deepest level of light children to the root's path: logarithmically many
rounds over tables of paths. One suffix sum along each path, from its end upward, then gives every subtree.

Conversations, paths and children of a node may be of any size: running values are carried from part to part (scans.py), other
figures are counts, sums and extremes that are added up before they are moved.

A turn's place is by turn (null first), then by SHA-256 of its role and text; null role or text is empty. Rows that repeat a turn
are turns each. Rows without a conv_id belong to no conversation and are left out. Texts may have any length. An empty
table has no conversation, hence no node, not even the root. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, small_batches, tidied, written
from .hashing import powers
from .scans import running, since, sums

#: A conversation is rebuilt from up to SHARED - 1 turns of the first conversation of its GROUP.
GROUP, SHARED = 5, 9
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Ids of members that a row holds on the way to their digest.
PIECE = 1 << 14
NODE = ["depth", "h1", "h2"]
PATH = ["hd", "p1", "p2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, size (of the text in bytes), digest (16 bytes) of each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, size = [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                role, text = (role or "").encode(), (text or "").encode()
                digests.append(hashlib.sha256(b"%d:%b%b" % (len(role), role, text)).digest()[:16])
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digests, pa.binary())], names=["conv_id", "turn", "size", "digest"])

    named = small_batches(conversations).filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return named.mapInArrow(tidied(run), "conv_id long, turn long, size long, digest binary")


def _numbered(turns: DataFrame) -> DataFrame:
    """turns with pos (from 1), s1, s2 (sums of the prefix that ends with the turn) and q1, q2 (of the one before it)."""

    def local(columns: dict, heads: np.ndarray) -> dict[str, np.ndarray]:
        n = len(columns["digest"])
        pos = np.arange(n) - since(heads, n) + 1
        halves = np.frombuffer(b"".join(columns["digest"].to_pylist()), "<u8").reshape(-1, 2)
        out = {"pos": pos}
        for i, base in enumerate(BASES):
            terms = halves[:, i] * powers(base, int(pos.max()) + 1)[pos]
            total = sums(terms, heads)
            out[f"s{i + 1}"], out[f"q{i + 1}"] = total.view(np.int64), (total - terms).view(np.int64)
        return out

    def join(carry: dict[str, int], values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {"pos": values["pos"] + carry["pos"]}
        for i, base in enumerate(BASES):
            before, shift = np.uint64(carry[f"s{i + 1}"] % (1 << 64)), np.uint64(pow(base, carry["pos"], 1 << 64))
            for k in (f"s{i + 1}", f"q{i + 1}"):
                out[k] = (before + shift * values[k].view(np.uint64)).view(np.int64)
        return out

    return running(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], ["pos", "s1", "q1", "s2", "q2"], local, join)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each turn of the rebuilt conversations, and a row for each conversation with its turns' number, n.

    The turns' rows: conv_id, depth, h1, h2 (the prefix that ends here), q1, q2 (the one before), size, last.
    """
    turns = written(_numbered(written(_turns(conversations))))
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    brief = F.struct("pos", "s1", "s2", "q1", "q2", "size")
    each = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"), F.array_sort(F.collect_list(F.when(F.col("pos") < SHARED, brief))).alias("own"))
    each = written(each)
    first = each.select(F.col("conv_id").alias("base"), F.col("own").alias("first"))
    convs = each.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "base", "left").withColumn("h", shared.cast("int"))
    convs = convs.withColumn("first", F.expr("CASE WHEN h = 0 OR first IS NULL THEN slice(own, 1, 0) ELSE slice(first, 1, h) END")).withColumn("m", F.size("first"))
    at = lambda array, i, field: f"coalesce(get({array}, {i} - 1).{field}, 0L) AS "
    convs = written(convs.selectExpr("conv_id", "n_own", "h", "m", "first", "m + greatest(0L, n_own - h) AS n", *(at("first", "m", f"s{i}") + f"b{i}" for i in (1, 2)), *(at("own", "least(h, size(own))", f"s{i}") + f"c{i}" for i in (1, 2))))
    fields = "conv_id long, depth long, h1 long, h2 long, q1 long, q2 long, size long, last boolean"
    begun = convs.select("conv_id", "n", F.explode("first").alias("x")).selectExpr("conv_id", "x.pos AS depth", "x.s1 AS h1", "x.s2 AS h2", "x.q1 AS q1", "x.q2 AS q2", "x.size AS size", "x.pos = n AS last")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = [powers(pow(base, -1, 1 << 64), SHARED) for base in BASES]
        for batch in batches:
            c = {k: v.to_numpy() for k, v in zip(batch.schema.names, batch.columns, strict=True)}
            out = {}
            for i in (1, 2):
                shift, b, own = back[i - 1][c["h"] - c["m"]], c[f"b{i}"].view(np.uint64), c[f"c{i}"].view(np.uint64)
                for name, given in (("h", "s"), ("q", "q")):
                    out[f"{name}{i}"] = (b + shift * (c[f"{given}{i}"].view(np.uint64) - own)).view(np.int64)
            depth = c["pos"] - c["h"] + c["m"]
            columns = [c["conv_id"], depth, out["h1"], out["h2"], out["q1"], out["q2"], c["size"], depth == c["n"]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[f.split()[0] for f in fields.split(", ")])

    ahead = turns.filter(F.col("pos") > shared).select("conv_id", "pos", "s1", "s2", "q1", "q2", "size").join(convs.drop("first", "n_own"), "conv_id")
    return written(begun.unionByName(ahead.mapInArrow(tidied(moved), fields))), convs.select("conv_id", "n")


def _members(rows: DataFrame) -> DataFrame:
    """ends_sha256 for each node of rows (depth, h1, h2, conv_id): of the conv_ids in ascending order, comma-joined.

    A node whose ids lie within a task is done there. Of others, and of long ones, the ids' text goes on in pieces to the one task
    that SHA-256, being sequential, needs for each of them; it holds a piece at a time.
    """
    fields = "depth long, h1 long, h2 long, part long, k long, piece string, ends_sha256 string"
    names = [f.split()[0] for f in fields.split(", ")]
    table = lambda out: pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*(o[:5] for o in out), strict=True)), *(pa.array([o[i] for o in out], pa.string()) for i in (5, 6))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, ids, k, opening = TaskContext.get().partitionId(), None, [], 0, True
        for batch in batches:
            out = []
            for depth, h1, h2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, h1, h2) != now or len(ids) >= PIECE:
                    whole = (depth, h1, h2) != now and not opening and not k
                    if ids:
                        text = ",".join(ids)
                        out.append((*now, part, k, None if whole else text, hashlib.sha256(text.encode()).hexdigest() if whole else None))
                    if (depth, h1, h2) != now:
                        opening, k = now is None, 0
                    else:
                        k += 1
                    now, ids = (depth, h1, h2), []
                ids.append(str(conv))
            if out:
                yield table(out)
        if ids:
            yield table([(*now, part, k, ",".join(ids), None)])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for depth, h1, h2, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, h1, h2) != now:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (depth, h1, h2), hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:3]), pa.array([o[3] for o in out])], names=[*NODE, "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([sha.hexdigest()])], names=[*NODE, "ends_sha256"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*NODE, "conv_id").repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    told = written(dealt.mapInArrow(tidied(run), fields))
    open_ = told.filter("piece IS NOT NULL").repartition(*NODE).sortWithinPartitions(*NODE, "part", "k").select(*NODE, "piece")
    return told.filter("piece IS NULL").select(*NODE, "ends_sha256").unionByName(open_.mapInArrow(tidied(ended), "depth long, h1 long, h2 long, ends_sha256 string"))


def _paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes below the root with level (light nodes from the root to here) and the top of their path: hd, p1, p2 (0, 0, 0 for the root's)."""

    def local(columns: dict, heads: np.ndarray) -> dict[str, np.ndarray]:
        light, n = columns["light"].to_numpy(zero_copy_only=False), len(columns["light"])
        top = np.maximum.accumulate(np.where(light, np.arange(n), -1))
        own = top >= since(heads, n)
        out = {"level": sums(light.astype(np.int64), heads)}
        return out | {k: np.where(own, columns[c].to_numpy()[top], 0) for k, c in zip(PATH, NODE, strict=True)}

    def join(carry: dict[str, int], values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        none = values["hd"] == 0
        return {"level": values["level"] + carry["level"]} | {k: np.where(none, np.int64(carry[k]), values[k]) for k in PATH}

    known = nodes.withColumnRenamed("conv_id", "least")
    along = written(rows.select("conv_id", *NODE).join(known, NODE))
    return running(along, ["conv_id"], [F.col("depth")], ["level", *PATH], local, join).filter("conv_id = least").drop("least", "light")


def _attached(nodes: DataFrame) -> DataFrame:
    """leaves_below and saved_below for each node at which light children hang: the sums over these children's subtrees."""
    tops = nodes.filter("depth = hd AND depth > 0").select(*PATH, "level", (F.col("depth") - 1).alias("depth"), F.col("q1").alias("h1"), F.col("q2").alias("h2"))
    over = nodes.select(*NODE, *(F.col(c).alias("over_" + c) for c in PATH))
    own = nodes.groupBy(*PATH).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    paths = written(tops.join(over, NODE).join(own, PATH), by="level")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done, below = [], None
    for level in range(deepest, 0, -1):
        now = paths.filter(F.col("level") == level).drop("level")
        if below is not None:
            now = now.join(below, PATH, "left").selectExpr(*PATH, *NODE, *("over_" + c for c in PATH), "leaves + coalesce(more_leaves, 0L) AS leaves", "saved + coalesce(more_saved, 0L) AS saved")
        now = written(now)
        done.append(now)
        below = now.groupBy(*(F.col("over_" + c).alias(c) for c in PATH)).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    hung = done[0] if done else paths.drop("level")
    for more in done[1:]:
        hung = hung.unionByName(more)
    return hung.groupBy(*NODE).agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(conversations)
    nodes = rows.groupBy(*NODE, "q1", "q2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in (*NODE, "q1", "q2")]
    nodes = written(nodes.unionByName(root.select(*zero, "n_convs", "conv_id", F.lit(0).cast("long").alias("size"))))
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("h1"), F.col("q2").alias("h2"))
    kids = below.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", F.expr("~conv_id").alias("first"), F.struct(nodes["h1"].alias("g1"), nodes["h2"].alias("g2")).alias("key"))).alias("best"))
    told = written(nodes.join(kids, NODE, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("best.key.g1").alias("g1"), F.col("best.key.g2").alias("g2")))
    up = told.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "g1", "g2")
    inner = told.drop("g1", "g2").join(up, ["depth", "q1", "q2"]).withColumn("light", ~((F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))).drop("g1", "g2")
    top = told.filter("depth = 0").drop("g1", "g2").withColumn("parent_conv_id", F.lit(None).cast("long"))
    none = [F.lit(0).cast("long").alias(c) for c in ("level", *PATH)]
    placed = _paths(rows, written(inner)).unionByName(top.select("*", *none))
    placed = written(placed.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).drop("size"))
    here = placed.join(_attached(placed), NODE, "left").withColumn("leaf", F.col("leaf") + F.coalesce("leaves_below", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("saved_below", F.lit(0)))
    here = written(here.select(*NODE, *PATH, "conv_id", "parent_conv_id", "n_convs", "n_children", "leaf", "saved"))

    def local(columns: dict, heads: np.ndarray) -> dict[str, np.ndarray]:
        return {k: sums(columns[c].to_numpy(), heads) for k, c in (("n_leaves", "leaf"), ("saved_tokens", "saved"))}

    summed = running(here, PATH, [F.col("depth").desc()], ["n_leaves", "saved_tokens"], local, lambda carry, values: {k: v + carry[k] for k, v in values.items()})
    ended = rows.filter("last").select(*NODE, "conv_id").unionByName(convs.filter("n = 0").select(*zero[:3], "conv_id"))
    sha = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return summed.join(_members(ended), NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha)


SQL = r"""
WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, key, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM p),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS own, pos, key, size FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, key, size FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
d AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS prefix, size FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
r AS (SELECT conv_id, depth, prefix, left(prefix, length(prefix) - 64) AS above, size FROM d UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM r GROUP BY conv_id),
m AS (SELECT prefix, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM e JOIN r USING (conv_id, depth) GROUP BY prefix),
n AS (SELECT prefix, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved FROM r GROUP BY prefix),
k AS (SELECT above AS prefix, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
s AS (SELECT r.prefix, sum(CASE WHEN k.prefix IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens FROM n LEFT JOIN k USING (prefix) JOIN r ON r.conv_id = n.conv_id AND r.depth <= n.depth GROUP BY r.prefix)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (prefix) LEFT JOIN k USING (prefix) LEFT JOIN m USING (prefix) LEFT JOIN n u ON u.prefix = n.above
"""

shipped(__name__)
