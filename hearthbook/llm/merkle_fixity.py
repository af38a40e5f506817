"""Fixity of WARC replicas by Merkle trees over ordered offset ranges.

Each record is hashed. The leaf of an archive's tree is the range of LEAF bytes in which
records begin; its hash covers the offsets and hashes of these records in order. FANOUT
neighbouring ranges make a range of the next level, up to the root. An audit compares the
roots of two replicas, then the children of nodes that differ, level by level, and at last
the records of the leaves that differ: sound branches are never opened.

A record takes up some bytes, so a range holds a bounded number of them however large an
archive is; no archive is ever gathered in one group, and offsets are running totals over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthbook.llm.common import text_of, written
from hearthbook.llm.scans import running

LEAF = 1 << 16
FANOUT = 16
#: Levels of ranges below the root, the leaves included: 4 GiB of an archive to a node of the last.
LEVELS = 5
PAGES_PER_ARCHIVE = 256


def record(url: Column, page_id: Column, payload: Column) -> Column:
    """A WARC response record as text: its header lines, the payload, two line ends."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"),
        F.lit(">\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def archived(pages: DataFrame) -> DataFrame:
    """(archive, offset, page_id, record_hash): pages as records of WARC archives.

    An archive holds PAGES_PER_ARCHIVE consecutive page ids, in their order, each at the
    offset where the one before ends; repeated ids follow each other by hash. A null url or
    html counts as empty; null ids are page id -1.
    """
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("page_id"),
        record(text_of("url"), F.coalesce(F.col("page_id").cast("long"), F.lit(-1)), text_of("html")).alias("record"),
    ).select(
        F.floor(F.col("page_id") / PAGES_PER_ARCHIVE).alias("archive"), "page_id",
        F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("record_hash"),
    )
    # Repeated records are counted before they move, so neither they nor a large archive meet in one task.
    counted = rows.groupBy("archive", "page_id", "record_hash").agg(F.first("length").alias("length"), F.count("*").alias("times"))
    sized = counted.withColumn("total", F.col("length") * F.col("times"))
    placed = running(sized, "archive", ["page_id", "record_hash"], sums=["total"], name="warc-offsets")
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("turn")
    return placed.select("archive", "page_id", "record_hash", "length", (F.col("total_run") - F.col("total")).alias("start"), turn).select(
        "archive", (F.col("start") + F.col("turn") * F.col("length")).alias("offset"), "page_id", "record_hash"
    )


def _joined_hash(order: str, *parts: str) -> Column:
    """The hash of the parts of all rows of a group, in order; equal places are ordered by their parts."""
    item = F.struct(F.col(order).alias("place"), F.concat_ws(":", *parts).alias("item"))
    return F.sha2(F.array_join(F.array_sort(F.collect_list(item))["item"], ","), 256)


def tree(records: DataFrame) -> DataFrame:
    """(level, archive, node, hash): all nodes of the tree of each archive; the root has level LEVELS, node 0.

    records has archive, offset and record_hash. An archive without records has no tree.
    """
    nodes = [level.select(F.lit(height).alias("level"), "archive", "node", "hash") for height, level in enumerate(levels(records))]
    return reduce(DataFrame.union, nodes)


def levels(records: DataFrame) -> list[DataFrame]:
    """(archive, node, hash) for each level of the tree, leaves first: each written once, and made of the one below."""
    level = records.groupBy("archive", F.floor(F.col("offset") / LEAF).alias("node")).agg(
        _joined_hash("offset", "offset", "record_hash").alias("hash")
    )
    made = [written(level, "merkle-0")]
    for height in range(1, LEVELS + 1):
        parent = F.floor(F.col("node") / FANOUT) if height < LEVELS else F.lit(0).cast("long")
        level = made[-1].groupBy("archive", parent.alias("parent")).agg(_joined_hash("node", "node", "hash").alias("hash"))
        made.append(written(level.withColumnRenamed("parent", "node"), f"merkle-{height}"))
    return made


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The records in which two replicas differ, with the roots of their archives.

    Columns: archive, offset, page_id, status (changed, missing or unexpected in the
    replica), primary_hash, replica_hash, primary_root, replica_root. Equal replicas, or
    two empty tables, give no rows. Records at the same offset are compared as a pair by
    their order of hash; archives of only one side come out whole.
    """
    one, two = levels(primary), levels(replica)

    def differing(height: int, parents: DataFrame | None) -> DataFrame:
        sides = []
        for name, nodes in (("primary", one), ("replica", two)):
            level = nodes[height].select("archive", "node", F.col("hash").alias(f"{name}_node"))
            if parents is not None:
                up = F.floor(F.col("node") / FANOUT) if height < LEVELS - 1 else F.lit(0).cast("long")
                level = level.withColumn("parent", up).join(
                    parents.select("archive", F.col("node").alias("parent")), ["archive", "parent"], "left_semi"
                ).drop("parent")
            sides.append(level)
        both = sides[0].join(sides[1], ["archive", "node"], "full_outer")
        return both.where(~F.col("primary_node").eqNullSafe(F.col("replica_node")))

    roots = written(differing(LEVELS, None), "merkle-roots")
    wrong = roots
    for height in range(LEVELS - 1, -1, -1):
        wrong = written(differing(height, wrong), f"merkle-wrong-{height}")
    keys = ["archive", "offset", "turn"]
    sides = []
    for name, records in (("primary", primary), ("replica", replica)):
        inside = records.withColumn("node", F.floor(F.col("offset") / LEAF)).join(
            wrong.select("archive", "node"), ["archive", "node"], "left_semi"
        )
        same = Window.partitionBy("archive", "offset").orderBy("record_hash")
        sides.append(inside.select(
            "archive", "offset", F.row_number().over(same).alias("turn"), F.col("page_id").alias(f"{name}_page"),
            F.col("record_hash").alias(f"{name}_hash"),
        ))
    found = sides[0].join(sides[1], keys, "full_outer").where(~F.col("primary_hash").eqNullSafe(F.col("replica_hash")))
    status = F.when(F.col("replica_hash").isNull(), "missing").when(F.col("primary_hash").isNull(), "unexpected").otherwise("changed")
    return found.join(roots.drop("node"), "archive").select(
        "archive", "offset", F.coalesce("primary_page", "replica_page").alias("page_id"), status.alias("status"),
        "primary_hash", "replica_hash", F.col("primary_node").alias("primary_root"), F.col("replica_node").alias("replica_root"),
    )


def damaged(records: DataFrame) -> DataFrame:
    """A replica for audits without a second copy at hand: some records altered, some lost, some alien.

    By crc32 of the page id modulo 128: 7 has another hash, 19 is lost, 31 has an alien record
    half way to the next one. Every record is read; what is damaged depends on ids only.
    """
    turn = F.crc32(F.col("page_id").cast("string")) % 128
    states = F.when(turn == 7, F.array(F.lit("altered"))).when(turn == 19, F.array().cast("array<string>")).when(
        turn == 31, F.array(F.lit("sound"), F.lit("alien"))
    ).otherwise(F.array(F.lit("sound")))
    rows = records.select("*", F.explode(states).alias("state"))
    return rows.select(
        "archive", (F.col("offset") + F.when(F.col("state") == "alien", 64).otherwise(0)).alias("offset"), "page_id",
        F.when(F.col("state") == "sound", F.col("record_hash")).otherwise(
            F.sha2(F.concat("record_hash", "state"), 256)
        ).alias("record_hash"),
    )


def fixity_audit(pages: DataFrame) -> DataFrame:
    """The audit of the archives of pages against their damaged replica."""
    records = written(archived(pages), "warc-records")
    return audit(records, damaged(records))
