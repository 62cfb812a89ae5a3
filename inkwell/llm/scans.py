"""Running values over groups of any size: rows are dealt out in ranges, so a hot group lies over many tasks.

Each task runs over its sorted rows by itself. What a group has gathered in earlier parts is then a carry for the first group
of a part: one row for each part goes to the driver, and the carries are joined to the rows of those first groups alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shipped, tidied, written

Values = dict[str, np.ndarray]
#: Rows of a part, about.
PART_ROWS = 1 << 20


def running(rows: DataFrame, group: list[str], order: list[Column], outputs: list[str], local: Callable[[dict[str, pa.Array], np.ndarray], Values], join: Callable[[dict[str, int], Values], Values]) -> DataFrame:
    """rows with the outputs (long), the running values of each row's group up to and with the row.

    local(columns, heads) gives them for sorted rows whose groups begin at heads; join(carry, values) puts what a group has gathered
    before, its last row's values, in front of values of later rows.
    """
    spark, names = rows.sparkSession, rows.columns
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(most, -(-rows.count() // PART_ROWS))
    added = [T.StructField(c, T.LongType()) for c in ("part", "at", *outputs)]
    schema = T.StructType([*rows.schema.fields, *added, T.StructField("opening", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last, carry, opening = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = dict(zip(names, batch.columns, strict=True))
            keys = np.array([columns[g].to_numpy() for g in group])
            heads = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            values = local(columns, heads)
            first = int(heads[1]) if len(heads) > 1 else n
            if last is not None and (keys[:, 0] == last).all():
                for k, v in join(carry, {k: v[:first] for k, v in values.items()}).items():
                    values[k][:first] = v
            opening = keys[:, 0] if opening is None else opening
            last, carry = keys[:, -1], {k: int(v[-1]) for k, v in values.items()}
            place = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *place, *(pa.array(values[c]) for c in outputs), pa.array((keys == opening[:, None]).all(axis=0))], names=schema.names)

    dealt = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    table = written(dealt.mapInArrow(tidied(run), schema))
    ends = table.groupBy("part").agg(F.min_by(F.struct(*group), "at").alias("first"), F.max_by(F.struct(*group), "at").alias("last"), F.max_by(F.struct(*outputs), "at").alias("total"))
    carries, last, carry = {}, None, {}
    for e in sorted(ends.collect(), key=lambda e: e.part):  # a row for each part
        total = e.total.asDict()
        if e.first == last:
            carries[e.part] = carry
            if e.first == e.last:
                total = {k: int(v[0]) for k, v in join(carry, {k: np.array([v]) for k, v in total.items()}).items()}
        last, carry = e.last, total
    known = spark.sparkContext.broadcast(carries)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(schema.names, batch.columns, strict=True))
            part, opening = columns["part"].to_numpy(), columns["opening"].to_numpy(zero_copy_only=False)
            values = {c: columns[c].to_numpy().copy() for c in outputs}
            for p in set(np.unique(part[opening]).tolist()) & known.value.keys():
                mine = opening & (part == p)
                for k, v in join(known.value[p], {k: v[mine] for k, v in values.items()}).items():
                    values[k][mine] = v
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in names), *(pa.array(values[c]) for c in outputs)], names=[*names, *outputs])

    return table.mapInArrow(tidied(carried), T.StructType([*rows.schema.fields, *added[2:]]))


def since(heads: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows where its group begins."""
    return np.repeat(heads, np.diff(np.append(heads, n)))


def sums(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Running sums within the groups; unsigned ones wrap around."""
    upto = np.cumsum(x, dtype=x.dtype)
    start = since(heads, len(x))
    return upto - upto[start] + x[start]


shipped(__name__)
