"""Connected components within pages, and ink blobs from runs of pixels."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.sources.shared import stored, together


#: Rows whose pages are handled together.
ROWS = 1 << 17


def by_pages(rows: DataFrame, order: list[str], f: Callable[[pa.Table], pa.Table], schema: StructType | str, key: str = "page_id") -> DataFrame:
    """f of whole pages' (or another key's) rows, each page's in this order: one shuffle, and one call for many small pages. A task holds no more than some rows and the page they end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, want = 0, ROWS
        for batch in (b for b in batches if b.num_rows):
            held.append(batch)
            n += batch.num_rows
            if n < want:
                continue
            table = pa.Table.from_batches(held)
            ids = table.column(key).to_numpy()
            end = int(np.searchsorted(ids, ids[-1]))  # where the last page begins
            if end:
                yield from f(table.slice(0, end)).to_batches()
            held, n = table.slice(end).combine_chunks().to_batches(), len(ids) - end
            want = max(ROWS, 2 * n)
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return together(rows, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def page_turns(page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each page begins in ascending page numbers, and the place of each row's page among them."""
    cuts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
    return cuts, np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(page))))


def _settle(page: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """page, node, component of whole pages' edges, by pointer jumping over all of them at once; page is ascending, a node that may have no edge has one to itself."""
    cuts, turn = page_turns(page)
    loops = a == b
    order = np.lexsort((a[loops], turn[loops]))
    nodes, of = a[loops][order], turn[loops][order]
    first, last = (int(f(nodes)) if len(nodes) else 0 for f in (np.min, np.max))
    if (last - first + 1) * len(cuts) >= 1 << 62:  # numbers far apart: their places among all
        known, first = np.unique(nodes), 0
        names, a, b, last = (*(np.searchsorted(known, x) for x in (nodes, a, b)), len(known))
    else:
        names = nodes
    span = last - first + 1
    at = lambda t, x: t * span + (x - first)  # noqa: E731 (a page and a node as one number)
    u, v = (np.searchsorted(at(of, names), at(turn[~loops], x[~loops])) for x in (a, b))
    label = _settled(len(nodes), u, v)
    return page[cuts][of], nodes, nodes[label]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id, node, component (its least node) from nodes (page_id, node) and edges (page_id, a, b).

    Nodes (as edges to themselves) and edges meet page by page in one shuffle; a task settles many small pages at once and holds no
    more than some rows and the page they end in: a page is bounded by its pixels.
    """
    page = nodes.schema["page_id"].dataType
    node = F.col("node").cast("long")
    nodes = nodes.select("page_id", node.alias("a"), node.alias("b"))
    edges = edges.select(F.col("page_id").cast(page).alias("page_id"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))

    def settled(table: pa.Table) -> pa.Table:
        found = _settle(*(c.to_numpy() for c in table.columns))
        return pa.table([pa.array(found[0], table.schema.field(0).type), *map(pa.array, found[1:])], names=["page_id", "node", "component"])

    return by_pages(nodes.unionByName(edges), [], settled, f"page_id {page.simpleString()}, node long, component long")


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """page_id, r, c0, c1 of each horizontal run of ink."""
    island = F.col("c") - F.row_number().over(W.partitionBy("page_id", "r").orderBy("c"))
    runs = pixels.filter("ink = 1").withColumn("island", island).groupBy("page_id", "r", "island")
    return runs.agg(F.min("c").alias("c0"), F.max("c").alias("c1")).select("page_id", "r", "c0", "c1")


def raster_runs(rasters: DataFrame) -> DataFrame:
    """page_id, r, c0, c1 of each horizontal run of ink of ink rasters or strips, without a row a pixel."""
    page = rasters.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = _runs(row)
                yield pa.RecordBatch.from_arrays([pa.array([row["page_id"]] * len(found[0]), batch.schema.field("page_id").type), *(pa.array(x.astype(np.int32)) for x in found)], names=["page_id", "r", "c0", "c1"])

    top = F.col("top") if "strip" in rasters.columns else F.lit(0).alias("top")
    return rasters.select("page_id", "height", "width", top, "data").mapInArrow(run, f"page_id {page}, r int, c0 int, c1 int")


def _runs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, c0, c1 of the runs of an ink raster whose first row is the page's row `top`."""
    ink = np.zeros((row["height"], row["width"] + 2), np.int8)
    ink[:, 1:-1] = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"])
    turn = np.diff(ink, axis=1)
    (r, first), (_, end) = np.nonzero(turn == 1), np.nonzero(turn == -1)
    return r + row["top"], first, end - 1


def _settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes the least that each is connected with, by edges a, b: pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(low, label[a], least)
        np.minimum.at(low, label[b], least)
        low = low[low]
        if (low == label).all():
            break
        label = low
    while (label[label] != label).any():
        label = label[label]
    return label


def linked(edges: DataFrame) -> DataFrame:
    """page_id, node, component (its least node) for the nodes of edges (page_id, a, b), by rounds of joins: no page is gathered.

    A round ties each node's larger neighbours, then its smaller ones and itself, to the least of all; rounds grow with the logarithm of
    the longest chain of edges. Each is a stored table.
    """
    page, pair = "page_id", ["page_id", "a", "b"]
    edges = stored(edges.select(page, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64(*pair).cast("decimal(38,0)")).alias("s"))
    seen = edges.agg(mark.alias("m")).first()["m"]
    while seen["n"]:
        both = edges.unionByName(edges.select(page, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(page, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, [page, "a"]).filter("b > a").select(page, F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy(page, "a").agg(F.min("b").alias("m"))
        ties = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("t")
        edges = stored(large.join(low, [page, "a"]).select(page, ties).select(page, "t.a", "t.b").filter("a > b").distinct())
        now = edges.agg(mark.alias("m")).first()["m"]
        if now == seen:
            break
        seen = now
    ends = edges.select(page, F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(page, F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Columns of a seam in which runs meet.
SEAM = 64


def strip_blobs(strips: DataFrame, min_area: int = 5, max_share: float = 0.03) -> DataFrame:
    """Blobs as of blobs(), of ink rasters in strips (images.strips).

    Each strip is labelled by itself, and only the runs of its first and last row look for others: they meet those of the strip
    beside it, and the labels that meet are joined in rounds. No task holds more than a strip.
    """
    page = strips.schema["page_id"].dataType.simpleString()
    names = ["page_id", "side", "label", "img_w", "img_h", "x1", "y1", "x2", "y2", "area"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                r, c0, c1 = _runs(row)
                if not len(r):
                    continue
                wide = row["width"] + 2
                starts, ends = r * wide + c0, r * wide + c1
                low, high = np.searchsorted(ends, starts + wide - 1), np.searchsorted(starts, ends + wide + 1, "right")
                n = np.maximum(high - low, 0)  # runs of the next row that touch
                a = np.repeat(np.arange(len(r)), n)
                b = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                label = _settled(len(r), a, b)
                node = r.astype(np.int64) * row["width"] + c0
                order = np.argsort(label, kind="stable")
                heads = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
                over = lambda f, x: f.reduceat(x[order], heads)
                parts = [np.zeros(len(heads), np.int64), node[label[order][heads]], over(np.minimum, c0), over(np.minimum, r), over(np.maximum, c1), over(np.maximum, r), over(np.add, c1 - c0 + 1)]
                last = row["top"] + row["height"] - 1
                tables = [parts]
                for side, at in ((1, np.flatnonzero(r == row["top"])), (2, np.flatnonzero(r == last))):
                    tables.append([np.full(len(at), side), node[label[at]], c0[at], r[at], c1[at], r[at], np.zeros(len(at), np.int64)])
                side, tag, *rest = (np.concatenate(c).astype(np.int64) for c in zip(*tables, strict=True))
                own = lambda v, t: pa.array([v] * len(side), t)
                yield pa.RecordBatch.from_arrays([own(row["page_id"], batch.schema.field("page_id").type), pa.array(side.astype(np.int32)), pa.array(tag), own(row["width"], pa.int32()), own(row["page_height"], pa.int32()), *(pa.array(c.astype(np.int32)) for c in rest)], names=names)

    told = strips.select("page_id", "height", "width", "top", "page_height", "data").mapInArrow(label, f"page_id {page}, side int, label long, img_w int, img_h int, x1 int, y1 int, x2 int, y2 int, area int")
    told = stored(told)
    cell = lambda x: F.floor(x / F.lit(float(SEAM))).cast("int")
    upper = told.filter("side = 2").select("page_id", (F.col("y1") + 1).alias("r"), F.explode(F.sequence(cell(F.col("x1") - 1), cell(F.col("x2") + 1))).alias("cell"), F.col("label").alias("a"), F.col("x1").alias("u1"), F.col("x2").alias("u2"))
    lower = told.filter("side = 1").select("page_id", F.col("y1").alias("r"), F.explode(F.sequence(cell(F.col("x1")), cell(F.col("x2")))).alias("cell"), F.col("label").alias("b"), "x1", "x2")
    met = upper.join(lower, ["page_id", "r", "cell"]).filter("x1 <= u2 + 1 AND u1 <= x2 + 1").select("page_id", "a", "b")
    tied = linked(met).select("page_id", F.col("node").alias("label"), "component")
    whole = told.filter("side = 0").join(tied, ["page_id", "label"], "left").groupBy("page_id", F.coalesce("component", "label").alias("blob_seq"), "img_w", "img_h")
    found = whole.agg(*(f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))), F.sum("area").cast("int").alias("area"))
    return _kept(found, min_area, max_share)


def blobs(pixels: DataFrame, min_area: int = 5, max_share: float = 0.03) -> DataFrame:
    """8-connected blobs with their place in raster order, boxes, areas and shapes; too small or too large ones are left out."""
    sizes = pixels.groupBy("page_id").agg((F.max("r") + 1).alias("img_h"), (F.max("c") + 1).alias("img_w"))
    return blobs_of_runs(pixel_runs(pixels), sizes, min_area, max_share)


def blobs_of_runs(runs: DataFrame, sizes: DataFrame, min_area: int = 5, max_share: float = 0.03) -> DataFrame:
    """The same from runs and sizes (page_id, img_h, img_w)."""
    runs = runs.join(sizes, "page_id").withColumn("node", F.col("r").cast("long") * F.col("img_w") + F.col("c0"))
    lower = runs.select("page_id", (F.col("r") - 1).alias("r"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("b"))
    edges = runs.withColumnRenamed("node", "a").join(lower, ["page_id", "r"]).filter("c0 <= d1 + 1 AND d0 <= c1 + 1").select("page_id", "a", "b")
    grouped = runs.join(components(runs.select("page_id", "node"), edges), ["page_id", "node"]).groupBy("page_id", "component", "img_w", "img_h")
    found = grouped.agg(F.min("c0").alias("x1"), F.min("r").alias("y1"), F.max("c1").alias("x2"), F.max("r").alias("y2"), F.sum(F.col("c1") - F.col("c0") + 1).cast("int").alias("area"))
    return _kept(found.withColumnRenamed("component", "blob_seq"), min_area, max_share)


def _kept(found: DataFrame, min_area: int, max_share: float) -> DataFrame:
    """Of blobs with their boxes and areas those that are neither too small nor too large."""
    found = found.withColumn("width", F.col("x2") - F.col("x1") + 1).withColumn("height", F.col("y2") - F.col("y1") + 1)
    return shaped(found.filter((F.col("area") >= min_area) & (F.col("width") * F.col("height") <= F.col("img_h") * F.col("img_w") * F.lit(max_share))))


def shaped(found: DataFrame, *more: str) -> DataFrame:
    """Blobs (and the columns `more`) with fill_ratio, aspect_ratio, center_r, center_c."""
    w, h = F.col("width"), F.col("height")
    extra = {"fill_ratio": F.col("area") / (w * h), "aspect_ratio": w / h, "center_r": (F.col("y1") + F.col("y2")) / 2.0, "center_c": (F.col("x1") + F.col("x2")) / 2.0}
    return found.select("page_id", "blob_seq", "img_w", "img_h", "x1", "y1", "x2", "y2", "width", "height", "area", *(e.alias(n) for n, e in extra.items()), *more)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed
