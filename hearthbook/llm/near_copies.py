"""Groups of near copies: texts linked by the exact Jaccard likeness of their shingle sets.

SimHash alone doesn't settle this: texts of likeness 0.8 may differ in over ten bits, and texts
within three bits may be less alike. So fingerprints only propose pairs, every link is verified on
the shingles, and what fingerprints miss is found by the groups of jaccard_groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hearthbook.llm import jaccard_groups, simhash
from hearthbook.llm.common import written


def by_fingerprint(marked: DataFrame, max_distance: int) -> DataFrame:
    """(src, dst): sets of equal or near fingerprints, as pairs to be verified."""
    full = marked.where("n > 0")
    first = full.groupBy("fp").agg(F.min("set_id").alias("first_set"))
    same = full.select("fp", "set_id").distinct().join(first, "fp").select(F.col("set_id").alias("src"), F.col("first_set").alias("dst"))
    near = (
        simhash.links(full, max_distance)
        .join(first.select(F.col("fp").alias("src"), F.col("first_set").alias("a")), "src")
        .join(first.select(F.col("fp").alias("dst"), F.col("first_set").alias("b")), "dst")
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )
    return same.union(near).where("src != dst")


def keep_one(
    docs: DataFrame, words: int = 5, least: float = 0.8, max_distance: int = 3, block: int = jaccard_groups.MEMBERS
) -> DataFrame:
    """docs without all but one document of each group of near copies: the smallest doc_id stays.

    Two texts are linked where their sets of `words`-word shingles have a Jaccard likeness of
    `least` or more, and a group is a component of links. Blank texts are one group. Rows of
    the same doc_id and text count as one; what stays is chosen as in simhash.keep_one. block is
    how many sets a group of the join holds.
    """
    marked = written(jaccard_groups.marks(docs, words, least, simhash.fold), "near-copies-marks")
    roots = jaccard_groups.roots_of(marked, docs, words, least, by_fingerprint(marked, max_distance), members=block)
    rooted = marked.select("doc_id", "text_hash", "set_id").join(roots, "set_id", "left")
    return simhash.kept_rows(docs, rooted.withColumn("root", F.coalesce("root", "set_id")))
