"""Fingerprints by a randomised embedding of edit distance into Hamming distance.

A walk reads a text from the left and at each step writes the character it stands on; a
random bit, drawn by the step and the character and shared by all texts, says whether it
moves on. Where two texts differ by an insertion or a deletion their walks soon meet again,
and from there they write the same, so texts few edits apart have embeddings that differ in
few places (Chakraborty, Goldenberg, Koucky 2016).

The fingerprint samples SAMPLES places of the embedding and keeps one byte of each, made
from the place and the character. Sample k is the place below the walk's length with the
smallest hash of k and place, so texts of unlike length are sampled at the same places as
far as both reach. The share of equal samples is the likeness.

The steps that a character takes are looked up by character and phase, so a walk costs one
addition per character; places are found afterwards. Random bits repeat after PERIOD steps.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthbook.llm.common import map_batches, remembered, text_of, texts, written
from hearthbook.llm.components import components
from hearthbook.llm.ordered import borders, part_of, shuffle_width

SAMPLES = 128
PERIOD = 4096
SEED = 20161
PARTS_PER_PARTITION = 4


def _steps(character: str) -> list[int]:
    """By phase, how many steps a walk stays on the character: up to its next set bit."""
    bits = np.random.default_rng([SEED, ord(character)]).integers(0, 2, PERIOD)
    bits[-1] = 1  # so that every walk moves on
    ones = np.flatnonzero(bits)
    return (ones[np.searchsorted(ones, np.arange(PERIOD))] - np.arange(PERIOD) + 1).tolist()


def _places() -> list[np.ndarray]:
    """For each sample the places that are sampled as texts get longer, ascending.

    These are the records of a random order of all places: after a record at r, the next one
    is beyond x with probability (r + 1) / (x + 1).
    """
    draws = np.random.default_rng(SEED)
    out = []
    for _ in range(SAMPLES):
        records = [0]
        while records[-1] < 1 << 50:
            records.append(int((records[-1] + 1) / max(draws.random(), 1e-12)) + 1)
        out.append(np.array(records, np.int64))
    return out


class Walker:
    def __init__(self) -> None:
        self.steps: dict[str, list[int]] = {}
        self.places = _places()
        self.longest = max(len(p) for p in self.places)
        top = np.iinfo(np.int64).max
        self.table = np.array([np.pad(p, (0, self.longest - len(p)), constant_values=top) for p in self.places])

    def walk(self, text: str, starts: array, at: int) -> int:
        """Appends the step at which each character begins; the step after the last one."""
        known = self.steps
        for c in set(text) - known.keys():
            if len(known) > 20_000:
                known.clear()
            known[c] = _steps(c)
        for c in set(text) - known.keys():
            known[c] = _steps(c)
        add, mask = starts.append, PERIOD - 1
        for steps in map(known.__getitem__, text):
            add(at)
            at += steps[at & mask]
        return at

    def sample(self, codes: np.ndarray, starts: np.ndarray, beyond: int) -> bytes:
        if not len(codes):
            return bytes(SAMPLES)
        found = (self.table < beyond).sum(axis=1) - 1
        place = self.table[np.arange(SAMPLES), found]
        read = codes[np.searchsorted(starts, place, side="right") - 1].astype(np.uint64)
        mixed = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (read * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(56)).astype(np.uint8).tobytes()

    def fingerprint(self, text: str) -> bytes:
        starts = array("q")
        beyond = self.walk(text, starts, 0)
        return self.sample(_codes(text), np.frombuffer(starts, np.int64), beyond)

    def fingerprints(self, text: str, kept: int, tail: str) -> tuple[bytes, bytes]:
        """Of the text, and of its first `kept` characters with another tail; the common part is walked once."""
        starts = array("q")
        middle = self.walk(text[:kept], starts, 0)
        other = starts[:]
        beyond = self.walk(text[kept:], starts, middle)
        other_beyond = self.walk(tail, other, middle)
        codes = _codes(text)
        return (
            self.sample(codes, np.frombuffer(starts, np.int64), beyond),
            self.sample(np.concatenate([codes[:kept], _codes(tail)]), np.frombuffer(other, np.int64), other_beyond),
        )


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def walker() -> Walker:
    """The worker's own, kept between batches and tasks."""
    return remembered(("edit_embedding",), Walker)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fingerprint) of each row; the fingerprint is SAMPLES bytes in hex.

    A null text counts as empty, whose fingerprint is zeros. Equal texts have equal ones.
    """

    def per_batch(batch: pa.RecordBatch) -> dict:
        known = walker()
        return {
            "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"),
            "fingerprint": [known.fingerprint(t).hex() for t in texts(batch)],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return map_batches(rows, per_batch, "doc_id long, text_hash long, fingerprint string")


# ---- near-duplicates: bands of sampled places, then verification


def band_links(prints: DataFrame, least: float = 0.8, bands: int | None = None, block: int = 1024) -> DataFrame:
    """(src, dst): links between different fingerprints that are alike to `least` or more.

    A band is every bands-th sample. There are more bands than samples in which two that are
    alike may differ (32 bands of 4 samples at 0.8), so these agree on one band at least.
    Fingerprints that agree on one are compared on all samples, and enough of the links found are kept to hold each band's components together. A band
    value shared by more than `block` fingerprints is dealt out by blocks, a task for each
    pair of blocks, so all of them are compared in bounded memory and none is left out.
    """
    allowed = int((1 - least) * SAMPLES + 1e-9)
    bands = bands or band_count(allowed)
    distinct = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
    cut = F.array(*[
        F.xxhash64(*[F.substring("fingerprint", 2 * i + 1, 2) for i in range(b, SAMPLES, bands)]) for b in range(bands)
    ])
    keyed = distinct.select(F.posexplode(cut).alias("band", "value"), "fingerprint")
    sizes = keyed.groupBy("band", "value").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    dealt = (
        keyed.join(sizes, ["band", "value"])
        .withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .select("band", "value", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "fingerprint")
    )
    keys = ["band", "value", "one", "two"]
    wanted = pa.schema([("src", pa.string()), ("dst", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            for *now, mark in zip(*(batch.column(k).to_pylist() for k in (*keys, "fingerprint")), strict=True):
                if now != key:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, _forest(members, allowed), [pa.string()] * 2)), schema=wanted)
                    key, members = now, []
                members.append(mark)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, _forest(members, allowed), [pa.string()] * 2)), schema=wanted)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src string, dst string").distinct()


def band_count(allowed: int) -> int:
    """The fewest bands of equal size that `allowed` differing samples can't all break."""
    return next(n for n in range(allowed + 1, SAMPLES + 1) if SAMPLES % n == 0)


def _forest(members: list[str], allowed: int) -> tuple[list[str], list[str]]:
    if len(members) < 2:
        return [], []
    rows = np.array([np.frombuffer(bytes.fromhex(m), np.uint8) for m in members])
    left = np.ones(len(rows), bool)
    src, dst = [], []
    while left.any():
        queue = [int(left.argmax())]
        left[queue[0]] = False
        while queue:
            node = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[(rows[rest] != rows[node]).sum(axis=1) <= allowed]
            left[near] = False
            src += [members[node]] * len(near)
            dst += [members[i] for i in near]
            queue += near.tolist()
    return src, dst


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, class_id): class_id is the smallest doc_id of those linked, itself included."""
    prints = written(fingerprints(docs), "edit-prints")
    stars = components(band_links(prints, least)).select(F.col("node").alias("fingerprint"), "root")
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")).join(stars, "fingerprint", "left")
    rooted = written(first.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first_id"), "edit-roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return prints.join(rooted.join(ids, "root").select("fingerprint", "class_id"), "fingerprint").select(
        "doc_id", "fingerprint", "class_id"
    )


# ---- each document, its edited text and its successor


def edited(text: str, following: str) -> tuple[int, str]:
    """How many characters stay, and the new tail: the last quarter gives way to the next text's beginning."""
    quarter = len(text) // 4
    return len(text) - quarter, following[:quarter]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """A row for each row of docs, compared with its edited text and with the next document.

    The order is by doc_id (null first), then by text; after the last comes the first. The
    rows are cut into ordered parts; each part also gets the first row of the next one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.lit(0).alias("extra"))
    count = shuffle_width(docs) * PARTS_PER_PARTITION
    cuts = borders(rows.select("doc_id"), count)
    ordered = rows.select("doc_id", "text", "extra", F.xxhash64("text").alias("text_hash"))
    # The first id of each part: as many rows as there are parts; then its first text.
    heads = rows.select("doc_id", part_of(cuts).alias("part")).groupBy("part").agg(F.min("doc_id").alias("head")).collect()
    filled = sorted((r["part"], r["head"]) for r in heads)
    if not filled:
        return ordered.where("false").select(
            "doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
            F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"),
        )
    before = {part: filled[i - 1][0] for i, (part, _) in enumerate(filled)}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(h, before[p]) for p, h in filled], "head long, part int")
    first_texts = (
        ordered.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("part").agg(F.min_by(F.struct("doc_id", "text", "text_hash"), F.struct("text_hash", "text")).alias("r"))
        .select("r.doc_id", "r.text", F.lit(1).alias("extra"), "r.text_hash", "part")
    )
    every = ordered.withColumn("part", part_of(cuts)).unionByName(first_texts)
    dealt = every.repartition(shuffle_width(docs), "part").sortWithinPartitions("part", "extra", "doc_id", "text_hash")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.select("doc_id", "text", "extra").mapInArrow(_along, schema)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts, in order; the extra row that ends a part is only looked at."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    known = walker()
    held = None  # (doc_id, text) that still waits for the next document
    waiting = None  # what is known of the row before, but for its likeness to the next
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "extra")), strict=True):
            if held is not None:
                kept, tail = edited(held[1], text)
                mark, other = known.fingerprints(held[1], kept, tail)
                if waiting is not None:
                    out.append((*waiting[0], likeness(waiting[1], mark)))
                digest = hashlib.sha256((held[1][:kept] + tail).encode("utf-8", "surrogatepass")).hexdigest()
                waiting = (held[0], len(held[1]), digest, mark.hex(), other.hex(), likeness(mark, other)), mark
            if extra:
                if waiting is not None:
                    out.append((*waiting[0], likeness(waiting[1], known.fingerprint(text))))
                held = waiting = None
            else:
                held = doc_id, text
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
