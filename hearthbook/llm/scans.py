"""Running totals in the order of a sort, over any number of partitions and any group size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from hearthbook.llm.common import written


def running(
    frame: DataFrame, group: str | None, order: Sequence[str], sums: Sequence[str] = (), xors: Sequence[str] = (), name: str = "running"
) -> DataFrame:
    """frame with `<column>_run` for each of sums and xors: the total of its group up to and with the row.

    Rows are range-sorted by (group, *order), which should tell them apart: a group of any size is spread
    over partitions like the rest. Each task adds up its own rows; what a group has in earlier tasks is
    added afterwards from a table of one row a task. group and the totalled columns are bigint without
    nulls; with group None all rows are one group. Sums must fit a long. An empty frame stays empty.
    """
    keys = [*([group] if group else []), *order]
    totalled = [*sums, *xors]
    names = frame.columns
    schema = StructType(list(frame.schema.fields)).add("_part", IntegerType()).add("_first", BooleanType())
    for column in totalled:
        schema = schema.add(f"{column}_run", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        opening = last = None
        carry = dict.fromkeys(totalled, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(group).to_numpy() if group else np.zeros(batch.num_rows, np.int64)
            opening = key[0] if opening is None else opening
            new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            runs = []
            for column in totalled:
                values = batch.column(column).to_numpy()
                operation, undo = (np.add, np.subtract) if column in sums else (np.bitwise_xor, np.bitwise_xor)
                runs.append(_restarted(values, new, operation, undo, carry[column]))
                carry[column] = runs[-1][-1]
            last = key[-1]
            columns = [*(batch.column(c) for c in names), pa.array(np.full(len(key), part, np.int32)), pa.array(key == opening)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, runs)], names=schema.names)

    ordered = frame.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    parts = written(ordered.mapInArrow(run, schema), name)
    by = F.col(group) if group else F.lit(0).cast("bigint")
    parts = parts.withColumn("_group", by)
    # Only the first group of a task can have begun in an earlier one; these tables have a row a task.
    spread = F.broadcast(parts.where("_first").select("_group").distinct())
    totals = [_total(c, c in sums).alias(f"{c}_all") for c in totalled]
    pieces = parts.join(spread, "_group", "left_semi").groupBy("_group", "_part").agg(*totals)
    earlier = "OVER (PARTITION BY _group ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = pieces.select(
        "_group", "_part", *[F.expr(f"{'sum' if c in sums else 'bit_xor'}({c}_all) {earlier}").alias(f"{c}_before") for c in totalled]
    )
    found = parts.join(F.broadcast(before), ["_group", "_part"], "left")
    return found.select(*names, *[_joined(c, c in sums).alias(f"{c}_run") for c in totalled])


def _total(column: str, summed: bool) -> Column:
    return F.sum(column) if summed else F.bit_xor(column)


def _joined(column: str, summed: bool) -> Column:
    before = F.coalesce(f"{column}_before", F.lit(0))
    run = F.col(f"{column}_run")
    return run + before if summed else run.bitwiseXOR(before)


def _restarted(values: np.ndarray, new: np.ndarray, operation: np.ufunc, undo: np.ufunc, carry: int) -> np.ndarray:
    """Running totals that start anew where new is set; rows before the first such place go on from carry."""
    total = operation.accumulate(values)
    starts = np.flatnonzero(new)
    segment = np.cumsum(new) - 1
    base = np.zeros(len(values), np.int64)
    inside = segment >= 0
    base[inside] = undo(total, values)[starts[segment[inside]]]
    found = undo(total, base)
    found[~inside] = operation(found[~inside], carry)
    return found
