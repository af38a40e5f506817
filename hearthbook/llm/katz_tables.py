"""A Katz back-off model of any order in stored tables, and scores by it for any documents.

With c the training counts, h a context of n - 1 tokens and h' the same without its first token:

    P(w | h) = d_n(c(h w)) * c(h w) / c(h)    if h w was seen
             = alpha(h) * P(w | h')           else; alpha is 1 for a context never seen
    P(w)     = d_1(c(w)) * c(w) / N           if w was seen
             = what these leave of 1          for all other words together

d_n is the Good-Turing discount of its order (katz.discounts). The shorter n-gram of a seen one is seen as well,
so alpha(h), the mass that the seen successors of h leave over what P(. | h') doesn't give
them, needs one join of two orders and is exact.

Tables under one path, partitioned by order:

    grams     (order, gram, n, log_p)       each seen n-gram, its count and log10 P of its last token
    weights   (order, context, log_alpha)   each context of an order above 1
    totals    (order, tokens, documents, log_unknown)   one row

A score is evaluated from the highest order down: a position that its order's table doesn't hold adds its context's
weight and goes on to the next order, so each order is one join of what is still open. n-grams go by 64-bit hashes.

katz.scores is the same model for order 2 with everything in one shuffle, within the budget of one query; this module
keeps the counts, scores what it wasn't trained on, and takes a shuffle for each order and side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthbook.llm.common import WORD_GAPS, fold_of, lower_ascii, text_of, written
from hearthbook.llm.katz import FOLDS, HELD_OUT, K, TAIL, discounts

# Tokens that no word's hash is taken for: the end of a document and what stands before its first word.
END, START = 0, -1


def _tokens(text: Column) -> Column:
    """The word hashes of a text, then the end."""
    words = F.array_remove(F.split(lower_ascii(text), WORD_GAPS), "")
    clear = F.transform(words, lambda w: F.when(F.xxhash64(w).between(START, END), F.xxhash64(w, F.lit(1))).otherwise(F.xxhash64(w)))
    return F.concat(clear, F.array(F.lit(END).cast("long")))


def positions(docs: DataFrame, order: int) -> DataFrame:
    """(row, doc_id, held_out, g1..gn, c2..cn): each token as the last one of an n-gram of each order, and that one's context.

    g1 is the token itself. Before its first word a document has order - 1 starts. row tells rows apart.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.col("doc_id").isNotNull() & (fold_of(FOLDS) == HELD_OUT)).alias("held_out"), _tokens(text_of()).alias("tokens"),
    )
    padded = F.concat(F.array_repeat(F.lit(START).cast("long"), order - 1), "tokens")
    rows = rows.withColumn("padded", padded)

    def at(i: Column) -> Column:
        held = [F.get(F.col("padded"), i + k) for k in range(order)]  # held[-1] is the token
        grams = [held[-1].alias("g1")] + [F.xxhash64(F.lit(n), *held[order - n:]).alias(f"g{n}") for n in range(2, order + 1)]
        contexts = [F.xxhash64(F.lit(n), *held[order - n : -1]).alias(f"c{n}") for n in range(2, order + 1)]
        return F.struct(*grams, *contexts)

    return rows.select("row", "doc_id", "held_out", F.inline(F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), at)))


def train(docs: DataFrame, path: str, order: int = 3) -> None:
    """Counts the training documents of docs (crc32 of the id modulo FOLDS isn't HELD_OUT) and writes the model to path."""
    spark = docs.sparkSession
    seen = positions(docs, order).where("NOT held_out")
    counts = []
    for n in range(1, order + 1):
        keys = [F.col(f"g{n}").alias("gram"), *([F.col(f"c{n}").alias("context"), F.col(f"g{n - 1}").alias("shorter")] if n > 1 else [])]
        counts.append(written(seen.groupBy(*keys).agg(F.count("*").alias("n")), f"katz-counts-{n}"))
    total = counts[0].agg(F.sum("n").alias("tokens"), F.max(F.when(F.col("gram") == END, F.col("n"))).alias("documents")).first()
    kept = []
    for table in counts:
        small = {r["n"]: r["times"] for r in table.where(F.col("n") <= K + 1).groupBy("n").agg(F.count("*").alias("times")).collect()}
        d = discounts(small)
        share = F.element_at(F.array(*[F.lit(x) for x in d[1:]], F.lit(1 - TAIL)), F.least(F.col("n"), F.lit(K + 1)).cast("int"))
        kept.append(table.withColumn("kept", share * F.col("n")))
    tokens = total["tokens"] or 0
    left = 1 - (kept[0].agg(F.sum("kept")).first()[0] or 0.0) / tokens if tokens else 1.0
    below = written(kept[0].select("gram", "n", (F.col("kept") / max(tokens, 1)).alias("p")), "katz-p-1")
    _stored(below, path, 1)
    for n in range(2, order + 1):
        # Both the sums per context and the chances of its n-grams come from one table in order of contexts.
        per = kept[n - 1].groupBy("context").agg(F.sum("n").alias("size"), F.sum("kept").alias("held"))
        chances = written(kept[n - 1].join(per.select("context", "size"), "context").select(
            "gram", "context", "shorter", "n", (F.col("kept") / F.col("size")).alias("p")), f"katz-p-{n}")
        covered = chances.join(below.select(F.col("gram").alias("shorter"), F.col("p").alias("shorter_p")), "shorter")
        covered = covered.groupBy("context").agg(F.sum("shorter_p").alias("covered"))
        alpha = (1 - F.col("held") / F.col("size")) / (1 - F.col("covered"))
        per.join(covered, "context").select("context", F.log10(alpha).alias("log_alpha")).write.parquet(f"{path}/weights/order={n}")
        below = chances.select("gram", "n", "p")
        _stored(below, path, n)
    last = [(order, tokens, total["documents"] or 0, left)]
    spark.createDataFrame(last, "order int, tokens long, documents long, unknown double").select(
        "order", "tokens", "documents", F.log10("unknown").alias("log_unknown")
    ).write.parquet(f"{path}/totals")


def _stored(chances: DataFrame, path: str, order: int) -> None:
    chances.select("gram", "n", F.log10("p").alias("log_p")).write.parquet(f"{path}/grams/order={order}")


def scored(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, score) of each row of docs by the model at path.

    score is the log10 chance of the whole text, its end included. Null and empty texts are one end.
    With a model of no documents every token has chance 1. Repeated rows come out repeated.
    """
    spark: SparkSession = docs.sparkSession
    total = spark.read.parquet(f"{path}/totals").first()
    order = total["order"]
    grams = spark.read.schema("gram long, n long, log_p double, order int").parquet(f"{path}/grams")
    still = positions(docs, order)
    kept = [c for n in range(1, order + 1) for c in (f"g{n}", *([f"c{n}"] if n > 1 else []))]
    # One row for each n-gram of a document, with how often it occurs there.
    open_ones = still.groupBy("row", "doc_id", "held_out", *kept).agg(F.count("*").alias("times")).withColumn("passed", F.lit(0.0))
    found = []
    for n in range(order, 0, -1):
        table = grams.where(F.col("order") == n).select(F.col("gram").alias(f"g{n}"), "log_p")
        joined = open_ones.join(table, f"g{n}", "left")
        if n > 1:
            joined = written(joined, f"katz-open-{n}")
            found.append(_settled(joined.where("log_p IS NOT NULL"), F.lit(True)))
            weights = spark.read.schema("context long, log_alpha double, order int").parquet(f"{path}/weights").where(F.col("order") == n)
            rest = joined.where("log_p IS NULL").drop("log_p", f"g{n}")
            rest = rest.join(weights.select(F.col("context").alias(f"c{n}"), "log_alpha"), f"c{n}", "left")
            open_ones = rest.withColumn("passed", F.col("passed") + F.coalesce("log_alpha", F.lit(0.0))).drop("log_alpha", f"c{n}")
        else:
            last = joined.withColumn("known", F.col("log_p").isNotNull()).withColumn("log_p", F.coalesce("log_p", F.lit(total["log_unknown"])))
            found.append(_settled(last, F.col("known")))
    return (
        reduce(DataFrame.union, found).groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
             F.sum("n_known").alias("n_known"), F.sum("score").alias("score"))
        .drop("row")
    )


def _settled(rows: DataFrame, known: Column) -> DataFrame:
    """Sums per document of positions whose order is found; words of a seen n-gram are known."""
    return rows.groupBy("row", "doc_id", "held_out").agg(
        F.sum("times").alias("n_tokens"), F.sum(F.when(known, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("times") * (F.col("passed") + F.col("log_p"))).alias("score"),
    )
