"""Exact percentiles in bounded memory: values counted by the leading bits of their place in the order, refined where the ranks lie."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits told apart a pass: a task counts at most 2**BITS places for each rank looked for.
BITS = 16
#: As many different values the driver may hold: where the ranks' places have at most these, they are counted one by one.
FEW = 1 << 16


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit numbers without sign in the same order; -0 as 0, NaN last."""
    whole = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(whole >> np.uint64(63), ~whole, whole | np.uint64(1 << 63))


def valued(places: np.ndarray) -> np.ndarray:
    """The doubles of ordered()."""
    return np.where(places >> np.uint64(63), places & np.uint64((1 << 63) - 1), ~places).view(np.float64)


def _counted(numbers: DataFrame, shift: int, known: list[int], above: int) -> dict[int, int]:
    """How many values have each place, cut by `shift` bits, among those whose place cut by `above` bits is known (64: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        want = np.array(known, np.uint64)
        for batch in batches:
            place = ordered(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64))
            if above < 64:
                place = place[np.isin(place >> np.uint64(above), want)]
            for p, n in zip(*(x.tolist() for x in np.unique(place >> np.uint64(shift), return_counts=True)), strict=True):
                total[p] = total.get(p, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array(list(total.values()), pa.int64())], names=["place", "n"])

    rows = numbers.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    return {r.place & (2**64 - 1): r.n for r in rows}


def at_ranks(numbers: DataFrame, ranks: Sequence[int] | None, shares: Sequence[float] = ()) -> tuple[int, dict[int, float]]:
    """How many values the only column (double, without nulls) has, and the values at these ranks (from 0) in their order.

    ranks None: those around share * (number - 1) for each share. Each pass counts the next BITS bits of the values that share their
    leading bits with one looked for, in tasks first: what a pass sends and the driver gets are at most 2**BITS counts for each
    rank, whatever the number of different values. There are 64 / BITS passes at most, and two where the first leaves few values.
    """
    above, shift = 64, 64 - BITS
    counts = _counted(numbers, shift, [], above)
    size = sum(counts.values())
    if ranks is None:
        ranks = [r for s in shares for r in _around(s, size)] if size else []
    sought = dict.fromkeys(ranks, (0, 0))  # leading bits, and how many values come before all that have them
    while sought:
        groups: dict[int, tuple[list[int], list[int]]] = {}
        for p in sorted(counts):
            places, ends = groups.setdefault(p >> (above - shift), ([], []))
            ends.append((ends[-1] if ends else 0) + counts[p])
            places.append(p)
        for r, (lead, before) in sought.items():
            places, ends = groups[lead]
            i = bisect_right(ends, r - before)
            sought[r] = (places[i], before + (ends[i - 1] if i else 0))
        if not shift:
            break
        leads = {p for p, _ in sought.values()}
        above, shift = shift, 0 if sum(counts[p] for p in leads) <= FEW else shift - BITS
        counts = _counted(numbers, shift, sorted(leads), above)
    return size, {r: float(valued(np.array([p], np.uint64))[0]) for r, (p, _) in sought.items()}


def _around(share: float, size: int) -> tuple[int, int]:
    low = int(share * (size - 1))
    return low, min(low + 1, size - 1)


def percentiles(rows: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact percentiles of a column read as doubles, linear between neighbours; None without values. Nulls are left out, NaN is the greatest value."""
    size, at = at_ranks(rows.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL"), None, shares)
    if not size:
        return [None] * len(shares)
    out = []
    for s in shares:
        low, high = _around(s, size)
        part = s * (size - 1) - low
        out.append(at[low] if not part or at[low] == at[high] else (1 - part) * at[low] + part * at[high])
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed
