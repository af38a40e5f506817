"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles. An item of q shingles counts as found
where a document holds at least threshold * q of them. The item's sketch is its bottom-k
MinHash: its k smallest shingle hashes, with k = q - ceil(threshold * q) + 1. A document
that misses all k lacks more shingles than the threshold allows, so looking for one shared
sketch hash finds every pair; the pairs are then verified on the shingles themselves.

Sketches are partitioned by item size. Each partition has a largest sketch hash and a
smallest number of shingles that a match needs; a document only looks at the partitions
that it is large enough for, and drops its hashes above their limit before the join. A
long document thus costs no more per shingle than a short one, however short the item is.

Words are what lies between ASCII white space, in lower case. Everything here is DataFrame
operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthbook.llm.common import WORD_GAPS, spare_name, text_of, written

#: Sketch rows (about 40 bytes each) up to which the sketch table is broadcast; a larger
#: one is joined by a shuffle on the hash. The rows found are the same.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_GAPS), "")


def _per_shingle(size: int, make) -> Column:
    """make(words at i, i+1, ...) for each place of the column `words`."""
    last = F.size("words") - size
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: make([F.get(F.col("words"), i + k) for k in range(size)])),
    ).otherwise(F.array())


def shingle_hashes(size: int) -> Column:
    return F.when(F.size("words") >= size, _per_shingle(size, lambda w: F.xxhash64(*w))).otherwise(
        F.array().cast("array<bigint>")
    )


def shingle_texts(size: int) -> Column:
    return F.when(F.size("words") >= size, _per_shingle(size, lambda w: F.concat_ws(" ", *w))).otherwise(
        F.array().cast("array<string>")
    )


def prepared_items(items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(item_id, shingles, q, need, sketch, size_class): one row for each different item.

    Items of fewer than `size` words (empty and null ones too) have no shingle and are left
    out: they can't be found in anything. Repeated rows count once.
    """
    return (
        items.select(F.col("item_id").cast("long").alias("item_id"), words_of(text_of()).alias("words"))
        .where(F.size("words") >= size)
        .select("item_id", F.array_distinct(shingle_texts(size)).alias("shingles"),
                F.array_sort(F.array_distinct(shingle_hashes(size))).alias("hashes"))
        .distinct()
        .withColumn("q", F.size("shingles"))
        .withColumn("need", F.ceil(F.round(F.col("q") * threshold, 9)).cast("int"))
        .select(
            F.xxhash64("item_id", "shingles").alias("item_key"), "item_id", "shingles", "q", "need",
            F.expr("slice(hashes, 1, q - need + 1)").alias("sketch"),
            F.floor(F.log2("q")).cast("int").alias("size_class"),
        )
    )


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, item_id, shared, item_shingles): every item found in every text.

    shared is the number of different shingles of the item that the text holds. Null and
    empty texts hold nothing. Rows of the same doc_id and text come out once per item; rows
    of one doc_id with different texts are told apart by text_hash. Null ids are kept.
    """
    known = written(prepared_items(items, size, threshold), "benchmark-items")
    sketch = known.select("item_key", "size_class", F.explode("sketch").alias("hash"))
    # One row per power of two of the item size: at most 32.
    parts = (
        known.groupBy("size_class")
        .agg(F.min("need").alias("need"), F.max(F.element_at("sketch", -1)).alias("limit"))
        .orderBy("need").collect()
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"),
        words_of(text_of()).alias("words"),
    )
    if not parts:
        return texts.where("false").select(
            "doc_id", "text_hash", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("shared"),
            F.lit(None).cast("int").alias("item_shingles"),
        )
    limit, highest = F.lit(None).cast("long"), None
    for part in parts:
        highest = part["limit"] if highest is None else max(highest, part["limit"])
        limit = F.when(F.size("hashes") >= part["need"], F.lit(highest)).otherwise(limit)
    probes = (
        texts.select("doc_id", "text_hash", shingle_hashes(size).alias("hashes"))
        .select("doc_id", "text_hash", F.size("hashes").alias("n"), "hashes", limit.alias("limit"))
        .select("doc_id", "text_hash", "n",
                F.explode(F.filter("hashes", lambda h: h <= F.col("limit"))).alias("hash"))
    )
    needs = reduce(
        lambda e, p: e.when(F.col("size_class") == p["size_class"], F.lit(p["need"])), parts[1:],
        F.when(F.col("size_class") == parts[0]["size_class"], F.lit(parts[0]["need"])),
    )
    side = sketch.withColumn("least", needs)
    if sketch.count() <= broadcast_rows:
        side = F.broadcast(side)
    pairs = (
        probes.join(side, (probes["hash"] == side["hash"]) & (F.col("n") >= F.col("least")))
        .select("doc_id", "text_hash", "item_key").distinct()
    )
    pairs = written(pairs, "benchmark-pairs")
    wanted = pairs.select(F.col("doc_id").alias("pair_id"), F.col("text_hash").alias("pair_hash")).distinct()
    same_row = F.col("doc_id").eqNullSafe(F.col("pair_id")) & (F.col("text_hash") == F.col("pair_hash"))
    held = (
        texts.join(wanted, same_row, "left_semi")
        .groupBy("doc_id", "text_hash").agg(F.min("words").alias("words"))
        .select(F.col("doc_id").alias("pair_id"), F.col("text_hash").alias("pair_hash"),
                F.array_distinct(shingle_texts(size)).alias("in_text"))
    )
    return (
        pairs.join(held, same_row)
        .join(known.select("item_key", "item_id", "shingles", "q", "need"), "item_key")
        .withColumn("shared", F.size(F.array_intersect("in_text", "shingles")))
        .where("shared >= need")
        .select("doc_id", "text_hash", "item_id", "shared", F.col("q").alias("item_shingles"))
    )


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): the largest of each pair of ids."""
    found = contained_items(docs, items, size, threshold)
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct(F.col("shared") / F.col("item_shingles"), "shared", "item_shingles")).alias("best"))
        .select("doc_id", "item_id", F.col("best.shared").cast("long").alias("shared"),
                F.col("best.item_shingles").cast("long").alias("item_shingles"),
                F.col("best.col1").alias("containment"))
    )


def without_benchmark(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns."""
    found_id, found_hash = spare_name(docs, "found_id"), spare_name(docs, "found_hash")
    found = contained_items(docs, items, size, threshold).select(
        F.col("doc_id").alias(found_id), F.col("text_hash").alias(found_hash)
    ).distinct()
    return docs.join(
        found,
        F.col("doc_id").cast("long").eqNullSafe(F.col(found_id)) & (F.xxhash64(text_of()) == F.col(found_hash)),
        "left_anti",
    )
