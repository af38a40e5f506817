"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into max_distance // 2 + 1 segments, so that of two fingerprints
within max_distance at least one segment differs by one bit at most. Each segment is
indexed with each of its bits left out in turn; two fingerprints within the distance
share one of these signatures, and sharing one is checked on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hearthbook.llm.common import map_batches, spare_name, text_of, texts, written
from hearthbook.llm.components import components

#: Distinct fingerprints under one signature that one task compares at once; more are split.
BLOCK = 2048
HASH_SEED = 42
_AT_ONCE = 65_536


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The unsigned hash of each shingle, in order; a text of fewer words is one shingle."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    return np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), "<u8", len(shingles))


def fold(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint: a bit is set where over half of the shingle hashes set it."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        part = hashes[at : at + _AT_ONCE]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    packed = np.packbits(set_bits * 2 > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def simhash(text: str, words: int = 3) -> int:
    """The fingerprint of a text; zero for a blank one."""
    return fold(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, seen_as: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for each row of docs, repeated rows included.

    A null or blank text has fingerprint zero. text_hash, with doc_id, tells rows apart.
    """

    def per_batch(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column("doc_id"),
            "text_hash": batch.column("text_hash"),
            "fp": [simhash(t, words) for t in texts(batch)],
        }

    rows = docs.select(
        F.col("doc_id").cast("long"), text_of(seen_as).alias("text"), F.xxhash64(text_of(seen_as)).alias("text_hash")
    )
    return map_batches(rows, per_batch, "doc_id long, text_hash long, fp long")


def segments(max_distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    count = max_distance // 2 + 1
    edges = [round(i * 64 / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def signatures(fps: DataFrame, max_distance: int) -> DataFrame:
    """(variant, value, fp): every one-wildcard form of every segment of every fingerprint."""
    values = []
    for low, width in segments(max_distance):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        values += [part.bitwiseAND(F.lit(_signed(~(1 << bit)))) for bit in range(width)]
    return fps.select(F.posexplode(F.array(*values)).alias("variant", "value"), "fp")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, max_distance: int) -> tuple[list[int], list[int]]:
    """Links that join what is within max_distance of each other, without spare ones."""
    bits = np.ascontiguousarray(fps).view(np.uint64)  # numpy counts the bits of a negative number's absolute value
    left = np.ones(len(fps), bool)
    parents: list[int] = []
    found: list[int] = []
    while left.any():
        first = int(left.argmax())
        left[first] = False
        queue = [first]
        while queue:
            node = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(bits[rest] ^ bits[node]) <= max_distance]
            left[near] = False
            parents += [int(fps[node])] * len(near)
            found += fps[near].tolist()
            queue += near.tolist()
    return parents, found


def _within_groups(max_distance: int, keys: tuple[str, ...], block: int | None):
    """For rows sorted by keys: links within each group, or the rows of a group beyond block."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), *((k, pa.int64()) for k in keys)])

    def out(src: list, dst: list | None, key: list | None = None) -> pa.RecordBatch:
        n = len(src)
        cols = [pa.array(src, pa.int64()), pa.array(dst, pa.int64()) if dst is not None else pa.nulls(n, pa.int64())]
        for i in range(len(keys)):
            cols.append(pa.array([int(key[i])] * n, pa.int64()) if key is not None else pa.nulls(n, pa.int64()))
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((len(keys) + 1, 0), np.int64)
        overflow = None  # the key of a group of which rows have been passed on already
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "fp")])
            rows = np.concatenate([held, new], axis=1)
            cuts = np.flatnonzero((rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from done(rows[:, :last], np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts, overflow)
            held = rows[:, last:]
            if last:
                overflow = None
            if block and held.shape[1] > block:
                overflow = held[:-1, 0].copy()
                yield out(held[-1].tolist(), None, overflow)
                held = held[:, :0]
        if held.shape[1]:
            yield from done(held, np.array([0]), overflow)

    def done(rows: np.ndarray, starts: np.ndarray, overflow: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        sizes = np.diff(np.append(starts, rows.shape[1]))
        src: list[int] = []
        dst: list[int] = []
        for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            key = rows[:-1, at]
            if overflow is not None and at == 0 and (key == overflow).all():
                yield out(rows[-1, :size].tolist(), None, key)
            elif block and size > block:
                yield out(rows[-1, at : at + size].tolist(), None, key)
            elif size == 2:
                a, b = int(rows[-1, at]), int(rows[-1, at + 1])
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= max_distance:
                    src.append(a)
                    dst.append(b)
            elif size > 2:
                a, b = forest(rows[-1, at : at + size], max_distance)
                src += a
                dst += b
        if src:
            yield out(src, dst)

    def only_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return only_groups, ", ".join(["src long", "dst long", *(f"{k} long" for k in keys)])


def links(fps: DataFrame, max_distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(src, dst): enough links between the distinct values of fps.fp to keep its components.

    All fingerprints within max_distance are connected through these links, none beyond are
    linked. Signatures shared by up to block fingerprints are settled by one task; a larger
    group is dealt into blocks, and each pair of blocks is settled by itself, so no task holds
    more than about twice block of them and nothing is left out. A group yields fewer links
    than it has members, never all its pairs.
    """
    keyed = signatures(fps.select("fp").where("fp IS NOT NULL").distinct(), max_distance)
    function, schema = _within_groups(max_distance, ("variant", "value"), block)
    found = written(
        keyed.repartition("variant", "value").sortWithinPartitions("variant", "value").mapInArrow(function, schema),
        "simhash-links",
    )
    sure = found.where("dst IS NOT NULL").select("src", "dst")
    large = found.where("dst IS NULL").select("variant", "value", F.col("src").alias("fp"))
    if large.isEmpty():
        return sure
    counts = large.groupBy("variant", "value").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = (
        large.join(counts, ["variant", "value"])
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select("variant", "value", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fp")
    )
    keys = ("variant", "value", "one", "two")
    function, schema = _within_groups(max_distance, keys, None)
    rest = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(function, schema)
    return sure.union(rest.select("src", "dst"))


def classes(marked: DataFrame, max_distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(fp, component_id): for each fingerprint, the smallest doc_id that its links reach.

    marked has doc_id and fp. A component of null ids only has a null component_id.
    """
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    stars = components(links(marked, max_distance, block)).select(F.col("node").alias("fp"), "root")
    rooted = least.join(stars, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    rooted = written(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, max_distance: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    fingerprint: 16 hex digits. Blank texts all have fingerprint zero and are linked like
    others. Equal texts share a fingerprint; repeated rows come out repeated.
    """
    marked = written(fingerprints(docs, words), "simhash-marks")
    return marked.join(classes(marked, max_distance, block), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 3, max_distance: int = 3, block: int = BLOCK) -> DataFrame:
    """docs without all but one document of each component: the smallest doc_id stays.

    Rows of the same doc_id and text count as one. Where a component has no ids at all, the
    text with the smallest hash stays. Any other columns are kept as they are.
    """
    marked = written(fingerprints(docs, words), "simhash-marks")
    return kept_rows(docs, marked.join(classes_by_root(marked, max_distance, block), "fp"))


def kept_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each root in rooted (doc_id, text_hash, root), the smallest id."""
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    chosen = rooted.groupBy("root").agg(F.min(best).alias("best"))
    kept_id, kept_hash, own_hash = (spare_name(docs, c) for c in ("kept_id", "kept_hash", "own_hash"))
    chosen = chosen.select(F.col("best.doc_id").alias(kept_id), F.col("best.text_hash").alias(kept_hash))
    rows = docs.withColumn(own_hash, F.xxhash64(text_of()))
    kept = rows.join(
        chosen,
        F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own_hash) == F.col(kept_hash)),
        "left_semi",
    )
    return kept.dropDuplicates(["doc_id", own_hash]).select(*docs.columns)


def classes_by_root(marked: DataFrame, max_distance: int, block: int) -> DataFrame:
    """(fp, root): each fingerprint and the one that stands for its component."""
    stars = components(links(marked, max_distance, block)).select(F.col("node").alias("fp"), "root")
    return marked.select("fp").distinct().join(stars, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
