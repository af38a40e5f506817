"""A trie of conversation prefixes, its subtrees added up by the Euler-tour technique.

A node is a distinct sequence of first turns. It is named by (conv_id, depth): its smallest member
and its number of turns. Prefixes are told apart by 128 bits, the xor of a hash of (place, role,
text) of each turn, so that prefixes of conversations of any length come from a running total.

Every node gets an arc into it and an arc out of it. The arcs in order of a walk around the trie
are one linked list: into a node, around each of its children, out of it. The list is ranked
(list_ranking), weights are added up in the order of the ranks, and what a subtree holds is the
running total at its way out less that at its way in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hearthbook.llm import list_ranking
from hearthbook.llm.common import written
from hearthbook.llm.scans import running

#: A conversation takes over turns of the first one of so many ids; how many is a checksum modulo LENDING.
FAMILY, LENDING = 5, 9
#: Characters of ids that a task holds of one node before it passes them on.
PIECE = 1 << 20

TURNS = ["conv_id", "depth", "bytes", "own1", "own2"]


def rebuilt(
    conversations: DataFrame, family: int = FAMILY, lending: int = LENDING, with_text: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, bytes, own1, own2) of the rebuilt conversations, and all ids (conv_id, n).

    Conversation c takes the first h turns of conversation c - c % family, h being crc32 of its
    decimal id modulo lending, then its own turns after its first h. own1 and own2 stand for role and
    text, bytes counts the text's UTF-8 bytes. Turns are in the order of turn, null first, then role,
    then text; repeated rows are repeated turns. A row without conv_id belongs to no conversation.
    With with_text, turns have role and text as well.
    """
    said = ["role", "text"] if with_text else []
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("one"),
    )
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    placed = running(turns, "conv_id", ["turn", "role", "text"], sums=["one"], name="trie-turns").select(
        "conv_id", F.col("one_run").alias("place"), F.octet_length("text").cast("long").alias("bytes"),
        F.substring(content, 1, 16).alias("left"), F.substring(content, 17, 16).alias("right"), *said,
    )
    placed = written(placed, "trie-placed")
    ids = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = ids.select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("lender"),
        (F.crc32(F.col("conv_id").cast("string")) % lending).alias("h"),
    )
    lenders = ids.select(F.col("conv_id").alias("lender"), F.col("n").alias("lent"))
    plan = plan.join(lenders, "lender", "left").select(
        "conv_id", "lender", F.when(F.col("conv_id") == F.col("lender"), 0).otherwise(F.col("h")).alias("h"),
        F.coalesce("lent", F.lit(0)).alias("lent"),
    )
    plan = written(plan, "trie-plan")
    taken = (
        plan.where("h > 0")
        .join(placed.where(F.col("place") < lending).withColumnRenamed("conv_id", "lender"), "lender")
        .where("place <= h").select("conv_id", F.col("place").alias("depth"), "bytes", "left", "right", *said)
    )
    kept = placed.join(plan, "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.least("h", "lent")).alias("depth"), "bytes", "left", "right", *said
    )
    own = [F.xxhash64(F.lit(seed), "depth", "left", "right").alias(name) for seed, name in ((1, "own1"), (2, "own2"))]
    return taken.union(kept).select("conv_id", "depth", "bytes", *own, *said), ids


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, at1, at2, own1, own2): each first part of each conversation, the empty one too."""
    parts = running(turns.select(*TURNS), "conv_id", ["depth"], xors=["own1", "own2"], name="trie-prefixes")
    zero = F.lit(0).cast("long")
    empty = ids.select("conv_id", *[zero.alias(c) for c in ("depth", "bytes", "at1", "at2", "own1", "own2")])
    return parts.select("conv_id", "depth", "bytes", F.col("own1_run").alias("at1"), F.col("own2_run").alias("at2"), "own1", "own2").union(empty)


def nodes_of(parts: DataFrame) -> DataFrame:
    """(id, conv_id, depth, parent, parent_conv_id, n_convs, bytes, at1, at2); ids count up in the order of (conv_id, depth).

    The root has id 0 and no parent. Members are counted in the tasks before they are shuffled.
    """
    found = parts.groupBy("depth", "at1", "at2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("own1").alias("own1"), F.max("own2").alias("own2"), F.lit(1).cast("long").alias("one"),
    )
    ranked = running(found, None, ["conv_id", "depth"], sums=["one"], name="trie-nodes").withColumn("id", F.col("one_run") - 1)
    below = ranked.select(
        "id", "conv_id", "depth", "n_convs", "bytes", "at1", "at2",
        (F.col("depth") - 1).alias("up"), F.col("at1").bitwiseXOR(F.col("own1")).alias("up1"), F.col("at2").bitwiseXOR(F.col("own2")).alias("up2"),
    )
    above = ranked.where("depth > 0").select(
        F.col("depth").alias("up"), F.col("at1").alias("up1"), F.col("at2").alias("up2"),
        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    root = ranked.where("depth < 1").select(F.col("depth").alias("up"), F.col("conv_id").alias("root_conv_id"))
    joined = below.join(above, ["up", "up1", "up2"], "left").join(F.broadcast(root), "up", "left")  # one row
    return joined.select(
        "id", "conv_id", "depth", F.when(F.col("up") == 0, 0).otherwise(F.col("parent")).alias("parent"),
        F.coalesce("parent_conv_id", "root_conv_id").alias("parent_conv_id"), "n_convs", "bytes", "at1", "at2",
    )


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (arc, next, leaf, saved) of the walk around the trie, and (parent, first, n_children).

    Arc 2 * id leads into a node, 2 * id + 1 out of it. Children are walked in the order of ids; a
    node's children are ranked over many tasks, so any number of them may hang on one node.
    """
    children = nodes.where("parent IS NOT NULL").select("id", "parent", F.lit(1).cast("long").alias("one"))
    ranked = written(
        running(children, "parent", ["id"], sums=["one"], name="trie-children").select("id", "parent", F.col("one_run").alias("k")), "trie-siblings"
    )
    kids = ranked.groupBy("parent").agg(F.min("id").alias("first"), F.count("*").alias("n_children"))
    following = ranked.select("parent", (F.col("k") - 1).alias("k"), F.col("id").alias("sibling"))
    beside = ranked.join(following, ["parent", "k"]).select("id", "sibling")
    all_of = (
        nodes.join(kids.select(F.col("parent").alias("id"), "first"), "id", "left").join(beside, "id", "left")
    )
    into = F.struct(
        (F.col("id") * 2).alias("arc"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("next"),
        F.col("first").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    out = F.struct(
        (F.col("id") * 2 + 1).alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"),
        F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"),
    )
    return all_of.select(F.inline(F.array(into, out))), kids


def subtrees(arcs: DataFrame, block: int = list_ranking.BLOCK, at_once: int = list_ranking.AT_ONCE) -> DataFrame:
    """(id, n_leaves, saved_tokens, enter, leave): sums below each node, and the places of its arcs in the walk."""
    ranks = list_ranking.list_ranks(arcs.select("arc", "next"), block, at_once)
    placed = arcs.join(ranks, "arc").select("arc", "position", "leaf", "saved")
    summed = running(placed, None, ["position"], sums=["leaf", "saved"], name="trie-walk")
    into = F.col("arc") % 2 == 0
    upto = [F.when(into, F.col(c) - F.col(f"{c}_run")).otherwise(F.col(f"{c}_run")) for c in ("leaf", "saved")]
    return summed.groupBy(F.shiftright("arc", 1).alias("id")).agg(
        F.sum(upto[0]).alias("n_leaves"), F.sum(upto[1]).alias("saved_tokens"),
        F.min("position").alias("enter"), F.max("position").alias("leave"),
    )


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(id, ends_sha256) for ends (id, conv_id): SHA-256 of each id's conv_ids, ascending and comma-joined.

    Rows are range-sorted by (id, conv_id), so the members of a frequent end are written out as text by many
    tasks. A node that lies whole in one task is hashed there; the pieces of others are hashed in order
    by one task a node (SHA-256 has no other way), which reads them one after another and holds none.
    """

    def text_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        now, held, size, whole = None, [], 0, False
        opening = True

        def row(text: str, sha: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([text]), pa.array([sha], pa.string())],
                names=["id", "part", "n", "text", "sha"],
            )

        for batch in batches:
            for node, conv in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        text = ",".join(held)
                        yield row("", hashlib.sha256(text.encode()).hexdigest()) if whole else row(text, None)
                        n += 1
                        opening = False
                    now, held, size, whole = node, [], 0, not opening
                held.append(str(conv))
                size += len(held[-1]) + 1
                if size >= piece:
                    yield row(",".join(held), None)
                    n, held, size, whole = n + 1, [], 0, False
        if held:
            yield row(",".join(held), None)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for node, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        yield _digest(now, state)
                    now, state = node, hashlib.sha256(text.encode())
                elif text:
                    state.update(b"," + text.encode())
        if now is not None:
            yield _digest(now, state)

    ordered = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces = written(ordered.mapInArrow(text_pieces, "id long, part int, n long, text string, sha string"), "trie-ends")
    rest = pieces.where("sha IS NULL").repartition("id").sortWithinPartitions("id", "part", "n").select("id", "text")
    return pieces.where("sha IS NOT NULL").select("id", F.col("sha").alias("ends_sha256")).union(
        rest.mapInArrow(hashed, "id long, ends_sha256 string")
    )


def _digest(node: int, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])


def prefix_trie(
    conversations: DataFrame, block: int = list_ranking.BLOCK, at_once: int = list_ranking.AT_ONCE, with_text: bool = False
) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter, leave),
    enter and leave being the places of its arcs in the walk. With with_text also role and text, the
    last turn of the node (null for the root).
    Null roles and texts are empty ones, null turns come first, repeated rows are repeated turns,
    rows without conv_id are left out. Conversations that end up without turns are members of the root.
    No conversations give no nodes. Other columns of conversations are not read.
    """
    turns, ids = rebuilt(conversations, with_text=with_text)
    parts = written(prefixes(turns, ids), "trie-parts")
    nodes = written(nodes_of(parts), "trie-named")
    arcs, kids = tour(nodes)
    arcs = written(arcs, "trie-arcs")
    sums = subtrees(arcs, block, at_once)
    last = parts.groupBy("conv_id").agg(F.max(F.struct("depth", "at1", "at2")).alias("last")).select("conv_id", "last.*")
    ends = last.join(nodes.select("id", "depth", "at1", "at2"), ["depth", "at1", "at2"]).select("id", "conv_id")
    none = hashlib.sha256(b"").hexdigest()
    found = (
        nodes.join(sums, "id")
        .join(kids.select(F.col("parent").alias("id"), "n_children"), "id", "left")
        .join(end_digests(ends), "id", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "enter", "leave",
        )
    )
    return found.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left") if with_text else found
