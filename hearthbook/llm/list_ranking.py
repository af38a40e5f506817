"""Places of the elements of linked lists that are spread over a cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.llm.common import written

#: Elements with neighbouring ids that one task joins to chains at once.
BLOCK = 262_144
#: A list contracted to so many elements is ranked by one task.
AT_ONCE = 65_536

LINKS = "arc long, next long, length long"


def list_ranks(links: DataFrame, block: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """(arc, position) for links (arc, next): how many elements of its list come before each one.

    Both are bigint; next is null at an end. Each arc is one row and follows at most one other;
    several lists may be given, and an empty table gives an empty one. Three steps, each written
    to the shared folder:

    1. Elements with neighbouring ids are cut into blocks, and each task joins what follows each
       other within a block to chains by pointer doubling. Only the heads of chains go on.
    2. While more than at_once heads are left, an element that draws heads takes in its follower
       that draws tails. A quarter of the elements goes in a round, so all rounds together move a
       few times the heads, not that times the number of rounds.
    3. What is left, at_once elements at most, is ranked by one task. Then the elements taken in
       get their places from those that took them in, the last round first.
    """
    chains = written(
        links.select("arc", "next").repartitionByRange("arc").sortWithinPartitions("arc").mapInArrow(_chains(block), _CHAINS),
        "ranks-chains",
    )
    left = chains.where("arc = head").select("arc", "next", "length")
    rounds = []
    while left.count() > at_once:
        taken = written(_taken(left, len(rounds)), "ranks-taken")
        rest = left.join(taken.select(F.col("gone").alias("arc")), "arc", "left_anti").join(taken.select("arc"), "arc", "left_anti")
        left = written(rest.unionByName(taken.select("arc", "next", "length")), "ranks-left")
        rounds.append(taken)
    places = written(left.repartition(1).mapInArrow(_whole, "arc long, position long"), "ranks-places")
    for taken in reversed(rounds):
        gone = taken.join(places, "arc").select(F.col("gone").alias("arc"), (F.col("position") + F.col("offset")).alias("position"))
        places = written(places.unionByName(gone), "ranks-places")
    heads = places.select(F.col("arc").alias("head"), F.col("position").alias("start"))
    return chains.join(heads, "head").select("arc", (F.col("start") + F.col("offset")).alias("position"))


def _coin(arc: str, turn: int) -> Column:
    return F.xxhash64(F.col(arc), F.lit(turn)).bitwiseAND(F.lit(1))


def _taken(left: DataFrame, turn: int) -> DataFrame:
    """(arc, gone, next, offset, length): arc takes in gone, which follows it, and goes on to next."""
    follower = left.select(F.col("arc").alias("gone"), F.col("next").alias("onward"), F.col("length").alias("more"))
    givers = left.where((_coin("arc", turn) == 1) & (_coin("next", turn) == 0)).withColumnRenamed("next", "gone")
    return givers.join(follower, "gone").select(
        "arc", "gone", F.col("onward").alias("next"), F.col("length").alias("offset"), (F.col("length") + F.col("more")).alias("length")
    )


_CHAINS = "arc long, head long, offset long, next long, length long"


def _chains(block: int):
    def cut(arc: np.ndarray, follower: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        head, offset, after = _joined(arc, np.where(ends, -1, follower), ends, np.ones(len(arc), np.int64))
        tails = after < 0
        onward = np.zeros(len(arc), np.int64)
        length = np.zeros(len(arc), np.int64)
        at_end = np.zeros(len(arc), bool)
        onward[head[tails]] = follower[tails]
        at_end[head[tails]] = ends[tails]
        length[head[tails]] = offset[tails] + 1
        inner = head != np.arange(len(arc))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(arc), pa.array(arc[head]), pa.array(offset),
                pa.array(onward, mask=inner | at_end), pa.array(length, mask=inner),
            ],
            names=["arc", "head", "offset", "next", "length"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield cut(*_link_columns(held))
                held, rows = [], 0
        if rows:
            yield cut(*_link_columns(held))

    return run


def _link_columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(batches)
    ends = table.column("next").is_null().to_numpy(zero_copy_only=False)
    return table.column("arc").to_numpy(), table.column("next").fill_null(0).to_numpy(), ends


def _joined(arc: np.ndarray, follower: np.ndarray, ends: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For arcs in ascending order: index of the head of each one's chain, the length before it, index of its follower or -1."""
    here = np.arange(len(arc))
    at = np.minimum(np.searchsorted(arc, follower), len(arc) - 1)
    after = np.where(~ends & (arc[at] == follower), at, -1)
    linked = after >= 0
    head = here.copy()
    offset = np.zeros(len(arc), np.int64)
    head[after[linked]] = here[linked]
    offset[after[linked]] = length[linked]
    while True:
        further = head[head]
        if (further == head).all():
            return head, offset, after
        offset += offset[head]
        head = further


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is not None:
        arc, follower, ends = _link_columns(table.to_batches())
        order = np.argsort(arc)
        length = table.column("length").to_numpy()[order]
        _, offset, _ = _joined(arc[order], follower[order], ends[order], length)
        yield pa.RecordBatch.from_arrays([pa.array(arc[order]), pa.array(offset)], names=["arc", "position"])
