"""Scoring regions as display equations, suppressing nested ones, and what is left as text."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.sources.shared import stored

from .components import by_pages
from .regions import by_class

# Fixed values by density class (sparse, medium, dense).
CONFIG = {
    "score_threshold": (4, 5, 7),
    "confidence_cutoff": (0.35, 0.4, 0.45),
    "frac_bar_w_factor": (0.8, 1.0, 1.2),
    "frac_bar_h_factor": (0.22, 0.20, 0.16),
    "frac_bar_score": (4, 3, 3),
    "tall_sym_threshold": (0.02, 0.04, 0.05),
    "tall_sym_score": (4, 2, 2),
    "cv_h_low": (0.35, 0.50, 0.60),
    "cv_h_high": (0.80, 1.00, 1.10),
    "outlier_low": (0.08, 0.05, 0.12),
    "outlier_high": (0.25, 0.50, 0.35),
    "height_ratio_min": (1.2, 1.8, 2.0),
    "region_ar_bonus": (2.0, 3.0, 2.5),
    "single_line_body_ratio": (0.70, 0.60, 0.60),
    "small_blob_max": (14, 12, 10),
    "small_h_ratio_max": (1.5, 1.7, 1.9),
    "wide_uniform_ar": (3, 3, 3),
    "para_h_ratio": (5.0, 4.0, 3.5),
    "para_cv_h": (0.65, 0.55, 0.50),
    "font_size_small": (10, 12, 14),
}
KEYS = ["page_id", "para", "part"]
FEATURES = ["cv_h", "cv_ar", "outlier_ratio", "tall_sym_ratio", "height_ratio", "region_ar", "mean_h_ratio", "center_span", "body_ratio", "band_ratio", "area_ratio", "blobs_per_lh", "text_density", "operator_ratio"]


def _cfg(name: str) -> Column:
    return by_class(CONFIG[name])


def config(spark) -> DataFrame:
    """The parameters as rows: density_class and one column each."""
    return spark.createDataFrame([(k, *(float(v[k]) for v in CONFIG.values())) for k in range(3)], ["density_class", *CONFIG])


def configured(classes: DataFrame) -> DataFrame:
    """The rows, which have a density_class, with its parameters as columns; three rows of these are broadcast."""
    return classes.join(F.broadcast(config(classes.sparkSession)), "density_class")


def features(parts: DataFrame, regions: DataFrame, top_margin: float = 0.05) -> DataFrame:
    """Each region (below the top margin, with two blobs or more) with the statistics of its members."""
    fs, w, h = F.col("font_size"), F.col("rx2") - F.col("rx1"), F.col("ry2") - F.col("ry1")
    boxes = regions.select(*KEYS, *(F.col(c).alias(f"r{c}") for c in ("x1", "y1", "x2", "y2")))
    boxes = boxes.filter((w > 0) & (h > 0))
    rows = parts.join(boxes, KEYS).filter(F.col("ry2") >= F.col("img_h") * top_margin)
    share = lambda c: F.count_if(c) / F.count("*")
    bh, bw, ar = F.col("height"), F.col("width"), F.col("aspect_ratio")
    odd = (bh > fs * 1.8) | ((bw > fs * 4) & (bh < fs * 0.5))
    outer = (F.col("center_c") < F.col("rx1") + w * 0.15) | (F.col("center_c") > F.col("rx1") + w * 0.85)
    sum_h, n = F.sum(bh), F.count("*")
    out = rows.groupBy(*KEYS, "font_size", "density_class", "img_w", "img_h", "rx1", "ry1", "rx2", "ry2").agg(
        n.alias("n"),
        (F.sqrt((n * F.sum(bh * bh) - sum_h * sum_h).cast("double")) / sum_h).alias("cv_h"),
        (F.stddev_pop(ar) / F.avg(ar)).alias("cv_ar"),
        (F.count_if(bh > fs * 1.8) + F.count_if((bw > fs * 4) & (bh < fs * 0.5))).alias("outliers"),
        F.count_if((bw > fs * _cfg("frac_bar_w_factor")) & (bh <= F.greatest(F.lit(2.0), fs * _cfg("frac_bar_h_factor")))).alias("frac_bars"),
        share(bh > fs * 1.5).alias("tall_sym_ratio"),
        (F.avg(bh) / F.first("font_size")).alias("mean_h_ratio"),
        ((F.max("center_r") - F.min("center_r")) / F.first("font_size")).alias("center_span"),
        share((bh >= fs * 0.6) & (bh <= fs * 1.4)).alias("body_ratio"),
        share(F.abs(F.col("center_r") - (F.col("ry1") + F.col("ry2")) / 2.0) <= fs * 0.35).alias("band_ratio"),
        F.sum("area").alias("ink"),
        share((ar > 0.3) & (ar < 3) & (bh < fs * 1.3)).alias("operator_ratio"),
        F.count_if(odd & ~outer).alias("inner_odd"),
        F.count_if(odd).alias("odd"),
    )
    out = out.filter("n >= 2").withColumns({"w": w, "h": h}).withColumns(
        {
            "outlier_ratio": F.col("outliers") / F.col("n"),
            "height_ratio": F.col("h") / fs,
            "region_ar": F.col("w") / F.col("h"),
            "area_ratio": F.col("ink") / F.greatest(F.lit(1), F.col("w") * F.col("h")),
        }
    )
    centred = F.abs((F.col("rx1") + F.col("rx2")) / 2.0 - F.col("img_w") / 2.0) / F.col("img_w") < 0.20
    return out.withColumns(
        {
            "blobs_per_lh": F.col("n") / F.greatest(F.lit(1.0), F.col("height_ratio")),
            "text_density": F.col("n") / F.greatest(F.lit(1.0), F.col("w") / fs),
            "centered": centred & (F.col("w") < F.col("img_w") * 0.75),
            "edge_outliers": (F.col("n") > 10) & (F.col("odd") > 0) & (F.col("inner_odd") == 0) & (F.col("region_ar") > 8),
        }
    )


def _all(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


def scored(found: DataFrame) -> DataFrame:
    """With base_score, guarded (a hard rule says text), score, confidence and tag."""
    c = F.col
    fs, n = c("font_size"), c("n")
    few = F.when(c("blobs_per_lh") < 4, 3).when(c("blobs_per_lh") < 12, 1).otherwise(0)
    # What adds to the score and what takes from it.
    terms = [
        (c("cv_h") > _cfg("cv_h_low"), 2),
        (c("cv_h") > _cfg("cv_h_high"), 2),
        (c("cv_ar") > 0.8, 1),
        (c("outlier_ratio") > _cfg("outlier_low"), 2),
        (c("outlier_ratio") > _cfg("outlier_high"), 3),
        (c("height_ratio") > _cfg("height_ratio_min"), 1),
        (c("region_ar") < _cfg("region_ar_bonus"), 1),
        (c("center_span") > 1.2, 1),
        (c("body_ratio") < 0.4, 1),
        (c("frac_bars") >= 1, _cfg("frac_bar_score")),
        (c("tall_sym_ratio") > _cfg("tall_sym_threshold"), _cfg("tall_sym_score")),
        (c("centered") & (c("cv_h") > 0.45), 1),
        (c("operator_ratio") > 0.18, 2),
        (_all(c("cv_h") > 0.7, c("cv_ar") > 0.6, c("body_ratio") < 0.4), 3),
        ((c("cv_h") < 0.2) & (c("height_ratio") < 1.3), -3),
        ((c("region_ar") > 8) & (c("h") < fs * 1.3), -4),
        (c("center_span") < 0.7, -2),
        ((c("body_ratio") > 0.7) & (c("height_ratio") < 1.6), -2),
        ((c("band_ratio") > 0.7) & (c("height_ratio") < 1.6), -1),
        ((c("area_ratio") > 0.35) & (c("height_ratio") > 2.5), -2),
        (c("edge_outliers"), -4),
    ]
    base = reduce(lambda a, b: a + b, [F.when(test, value).otherwise(0) for test, value in terms], few)
    plain_line = _all(c("height_ratio") < 1.5, c("center_span") < 0.9, c("body_ratio") > _cfg("single_line_body_ratio"))
    guards = [
        _all(c("text_density") > 2.5, c("cv_h") < 0.45),
        _all(c("mean_h_ratio") > 1.6, c("height_ratio") < 5, n < 40, c("cv_h") < 0.5, c("tall_sym_ratio") < 0.05, c("frac_bars") == 0),
        _all(c("region_ar") > 4, plain_line),
        _all(n <= _cfg("small_blob_max"), c("height_ratio") < _cfg("small_h_ratio_max"), c("center_span") < 1, c("body_ratio") > 0.5, c("band_ratio") > 0.5),
        _all(c("region_ar") > _cfg("wide_uniform_ar"), c("cv_h") < 0.5, c("cv_ar") < 0.5, c("band_ratio") > 0.6),
        _all(c("height_ratio") > _cfg("para_h_ratio"), c("cv_h") < _cfg("para_cv_h"), c("outlier_ratio") < 0.10, c("body_ratio") > 0.45),
        _all(c("height_ratio") > 6, c("cv_h") < 0.55, c("outlier_ratio") < 0.12, c("body_ratio") > 0.50),
        _all(c("region_ar") > 15, c("height_ratio") < 4, c("cv_h") < 0.55),
        _all(fs <= _cfg("font_size_small"), c("cv_h") < 0.65, c("frac_bars") == 0, c("tall_sym_ratio") < 0.05),
    ]
    guarded = reduce(lambda a, b: a | b, guards)
    clear = (c("region_ar") > 6) & plain_line
    bar = _all(c("frac_bars") >= 1, c("height_ratio") > 2, c("region_ar") < 5)
    tall = (c("tall_sym_ratio") > _cfg("tall_sym_threshold")) & (c("height_ratio") > 2.5)
    rescued = F.when(clear, -99).when(bar, _cfg("frac_bar_score") + 2).when(tall, 5).otherwise(-99)
    out = found.withColumn("base_score", base).withColumn("guarded", guarded)
    out = out.withColumn("score", F.when(c("guarded"), rescued).otherwise(c("base_score")))
    out = out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("score") / F.lit(20.0))))
    return out.withColumn("tag", F.when(c("score") >= _cfg("score_threshold"), "EQ").otherwise("TEXT"))


def candidates(rated: DataFrame) -> DataFrame:
    """Regions above the score threshold and the confidence cutoff: page_id, para, part, box, confidence, class (always 0)."""
    kept = rated.filter((F.col("score") >= _cfg("score_threshold")) & (F.col("confidence") > _cfg("confidence_cutoff")))
    box = [F.col(f"r{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return kept.select(*KEYS, *box, F.round("confidence", 3).alias("confidence"), F.lit(0).alias("class"))


#: Pages of at most so many boxes are judged as one array each; with more in any page all go by pairs.
FOLD = 512
#: Pairs of a page that one task may judge in turn.
PAIRS = 100_000


def suppress_nested(boxes: DataFrame, order: list[str], share: float = 0.7) -> DataFrame:
    """Greedy: larger boxes first, then by `order`; a box of which `share` lies in one kept before goes. Adds rank, the place in that order."""
    most = boxes.groupBy("page_id").count().agg(F.max("count")).first()[0] or 0
    return by_pairs(boxes, order, share) if most > FOLD and share > 0.5 else by_fold(boxes, order, share)


def _inside(d: Column, k: Column, share: float) -> Column:
    """Whether `share` of box d lies in k; `less` is its area below zero."""
    w = F.least(d["x2"], k["x2"]) - F.greatest(d["x1"], k["x1"])
    h = F.least(d["y2"], k["y2"]) - F.greatest(d["y1"], k["y1"])
    return (w > 0) & (h > 0) & (d["less"] < 0) & ((w * h) / (-d["less"]) >= share)


def _less() -> Column:
    return (-((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))).alias("less")


def by_fold(boxes: DataFrame, order: list[str], share: float = 0.7) -> DataFrame:
    """suppress_nested with each page's boxes as one array, which suits pages of few."""
    item = F.struct(_less(), *order, *[c for c in boxes.columns if c not in ("page_id", *order)])
    kind = boxes.select(item.alias("b")).schema["b"].dataType.simpleString()
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    keep = F.aggregate("all", F.array().cast(f"array<{kind}>"), lambda kept, d: F.when(F.exists(kept, lambda k: _inside(d, k, share)), kept).otherwise(F.concat(kept, F.array(d))))
    out = pages.select("page_id", F.posexplode(keep).alias("rank", "b"))
    return out.select("page_id", (F.col("rank") + 1).alias("rank"), *[F.col(f"b.{c}").alias(c) for c in boxes.columns if c != "page_id"])


#: Pairs that a task compares at a time.
STEP = 1 << 20
#: Rounds that a task goes through within its tiles for so many pairs; what is open then is left to the rounds between tiles.
ROUNDS = 256
TILE = ["page_id", "tx", "ty"]


def _tiles(boxes: DataFrame, whole: int) -> DataFrame:
    """boxes (page_id, turn, less, x1, y1, x2, y2) once for each tile that they cover: tile, a number of page_id, tx, ty; own, whether their middle lies there.

    A page of up to `whole` boxes is one tile. Else a tile's side is the power of two above twice the root of the mean square of
    the longer sides, so boxes cover few tiles on average, whatever their sizes.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).cast("double")
    page = W.partitionBy("page_id")
    level = F.ceil(F.log2(F.greatest(F.lit(1.0), F.sqrt(F.avg(side * side).over(page))))) + 1
    wide = F.when(F.count("*").over(page) > whole, F.pow(F.lit(2.0), level))
    cell = lambda x: F.coalesce(F.floor(x / F.col("wide")), F.lit(0)).cast("long")
    across = lambda a, b: F.explode(F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b))))
    middle = lambda a, b: cell((F.col(a).cast("double") + F.col(b)) / 2.0)
    sized = boxes.select("page_id", "turn", "less", "x1", "y1", "x2", "y2", wide.alias("wide")).filter("less < 0")
    dealt = sized.withColumn("tx", across(F.col("x1"), F.col("x2"))).withColumn("ty", across(F.col("y1"), F.col("y2")))
    own = (F.col("tx") == middle("x1", "x2")) & (F.col("ty") == middle("y1", "y2"))
    return dealt.select(F.xxhash64(*TILE).alias("tile"), *TILE, "turn", own.alias("own"), "x1", "y1", "x2", "y2")


def _open(i: np.ndarray, j: np.ndarray, mine: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Settles of the boxes `mine` what their pairs tell, in state (0: open, 1: stays, 2: goes); returns the pairs of those left open."""
    for _ in range(ROUNDS):
        waits = np.zeros(len(state), bool)
        waits[j] = True
        state[mine[~waits[mine] & (state[mine] == 0)]] = 1
        state[j[state[i] == 1]] = 2
        live = (state[i] != 2) & (state[j] != 2)
        if live.all():
            break
        i, j = i[live], j[live]
    return i, j


def _judged(boxes: DataFrame, share: float, whole: int, settle: bool) -> DataFrame:
    """page_id, i, j of boxes of which `share` (over a half) of the later, j, lies in the earlier, i; where a tile settles boxes by itself only those that go, with 0 for i, and the pairs that are left.

    The middle of j then lies in i, so the tile of j's middle has all that may hold it. Within a tile boxes go in turn, some at a
    time, and meet those alone that haven't gone.
    """

    def run(table: pa.Table) -> pa.Table:
        page, tx, ty, turn, own, *box = (table.column(c).to_numpy() for c in (*TILE, "turn", "own", "x1", "y1", "x2", "y2"))
        x1, y1, x2, y2 = (x.astype(np.int64) if x.dtype.kind in "iu" else x for x in box)
        fresh = np.append(True, (page[1:] != page[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1]))
        start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        area, state = (x2 - x1) * (y2 - y1), np.zeros(len(turn), np.int8)
        asking, at, found = np.flatnonzero(own), 0, [(np.zeros(0, np.int64),) * 2]
        while at < len(asking):
            here = np.flatnonzero(state != 2)
            first = np.searchsorted(here, start[asking[at:]])
            many = np.searchsorted(here, asking[at:]) - first
            n = max(1, int(np.searchsorted(np.cumsum(many), STEP, "right")))
            mine, first, many = asking[at : at + n], first[:n], many[:n]
            j = np.repeat(mine, many)
            i = here[np.arange(len(j)) + np.repeat(first - (np.cumsum(many) - many), many)]
            w, h = np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j]), np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j])
            inside = (w > 0) & (h > 0) & (w * h / area[j] >= share)
            i, j = i[inside], j[inside]
            found.append(_open(i, j, mine, state) if settle else (i, j))
            at += n
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        gone = np.flatnonzero(state == 2)
        return pa.table({"page_id": table.column("page_id").take(pa.array(np.append(gone, j))), "i": np.append(np.zeros(len(gone), np.int64), turn[i]), "j": turn[np.append(gone, j)]})

    page = boxes.schema["page_id"].dataType.simpleString()
    return by_pages(_tiles(boxes, whole), [*TILE, "turn"], run, f"page_id {page}, i long, j long", "tile")


def nested_pairs(boxes: DataFrame, share: float, whole: int = FOLD) -> DataFrame:
    """page_id, i, j of boxes (page_id, turn, less, x1, y1, x2, y2) of which `share` (over a half) of the later, j, lies in the earlier, i."""
    return _judged(boxes, share, whole, False)


def _in_turn(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one page's pairs the boxes that go."""
    pairs = pairs.sort_values(["j", "i"])
    gone: set[int] = set()
    for i, j in zip(pairs["i"].tolist(), pairs["j"].tolist(), strict=True):
        if i not in gone:
            gone.add(j)
    out = sorted(gone)
    return pd.DataFrame({"page_id": np.repeat(pairs["page_id"].to_numpy()[:1], len(out)), "j": np.array(out, np.int64)})


def by_pairs(boxes: DataFrame, order: list[str], share: float = 0.7, most: int = PAIRS) -> DataFrame:
    """suppress_nested by rounds over pairs: boxes that no other may remove stay, what lies in them goes, with all its pairs.

    Tiles of a page (_judged) go through the rounds where their boxes lie; pairs that hang on other tiles are settled in rounds
    over all. Each round settles at least the first of every chain of pairs; as soon as no page has more than `most` pairs left,
    these are gone through in turn, page by page. A page of more than `most` boxes, or FOLD, is never one tile.
    """
    page = boxes.schema["page_id"].dataType.simpleString()
    place = F.row_number().over(W.partitionBy("page_id").orderBy("less", *order))
    turned = stored(boxes.withColumn("less", _less()).withColumn("turn", place.cast("long")))
    found = stored(_judged(turned, share, min(FOLD, most), True))
    gone = [found.filter("i = 0").select("page_id", "j")]
    pairs = stored(found.filter("i > 0").join(gone[0].withColumnRenamed("j", "i"), ["page_id", "i"], "left_anti").select("page_id", "i", "j"))
    while (pairs.groupBy("page_id").count().agg(F.max("count")).first()[0] or 0) > most:
        firm = pairs.select("page_id", "i").distinct().join(pairs.select("page_id", F.col("j").alias("i")), ["page_id", "i"], "left_anti")
        out = stored(pairs.join(firm, ["page_id", "i"]).select("page_id", "j").distinct())
        pairs = stored(pairs.join(out, ["page_id", "j"], "left_anti").join(out.select("page_id", F.col("j").alias("i")), ["page_id", "i"], "left_anti").select("page_id", "i", "j"))
        gone.append(out)
    gone.append(pairs.groupBy("page_id").applyInPandas(_in_turn, f"page_id {page}, j long"))
    kept = turned.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("j", "turn"), ["page_id", "turn"], "left_anti")
    rank = F.row_number().over(W.partitionBy("page_id").orderBy("turn"))
    return kept.select("page_id", rank.alias("rank"), *(c for c in boxes.columns if c != "page_id"))


def text_regions(regions: DataFrame, detections: DataFrame) -> DataFrame:
    """Regions whose box is no detection's."""
    box = ["page_id", "x1", "y1", "x2", "y2"]
    return regions.select(*box).join(detections.select(*box), box, "left_anti")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed
