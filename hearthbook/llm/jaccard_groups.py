"""Jaccard join of shingle sets through a token-group matrix.

Sets that agree on the shingle of the smallest hash are likely alike and make a group; a large group
is cut into several of bounded size. The token-group matrix says for
each shingle which groups have it among the prefixes of their sets, with the sizes of those sets and what is left of
them from there on. A set is a query against every group; what the matrix says bounds the
shingles that it can share with any set of the group, and only where that reaches the threshold is the group opened
and the set compared with all its members, exactly.

Shingles have one order: rare ones by their hash, then frequent ones, the most frequent last. Of a set
of n shingles the first n - ceil(least * n) + 1 are its prefix, and two sets alike to `least`
share a shingle of their prefixes. Below a hash that no prefix ends before, all rare shingles of
either set are in its prefix; so what two sets have in common is at most the rare shingles that
their prefixes share, and all that either one has beyond that hash. For sets whose prefixes share
frequent shingles only, the first of these bounds the rest: from place i on a set of n has n - i. Alike sets have
least / (1 + least) * (n + m) in common, and groups that can't reach it stay closed. Which
shingles are frequent is estimated from a sample; any order gives the same links.

A dense cluster of k sets in g groups would open k * g groups, though k - 1 links join it. So groups are
opened in two rounds: first each set opens the group of the set that is next to it under most of its
shingles; then only groups with sets that the links found have not yet brought to the query's component.

Sets are compared as 64-bit hashes of their shingles, and only texts whose group is opened, or that
open one, are moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hearthbook.llm.common import discard, map_batches, text_of, texts, written
from hearthbook.llm.components import components

#: One text in SAMPLE is read for frequent shingles; those in OFTEN of them or more come last, FREQUENT at most.
SAMPLE, OFTEN, FREQUENT = 32, 4, 50_000
#: About so many sets, and shingles of them, make a group; larger ones are cut.
MEMBERS, TOKENS = 128, 1_000_000
#: Queries that one task compares with a group; for more, the group is given to several tasks.
QUERIES = 4096
#: Steps of the hash up to which a set counts its rare shingles.
CELLS = 128
#: Keys that are broadcast to choose texts; beyond that many the texts are shuffled.
BROADCAST_KEYS = 500_000
SEED = 42
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_KNOWN_WORDS = 100_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < _KNOWN_WORDS:
            self[word] = found
        return found


class Shingler:
    """Hashes of the shingles of a text: the hashes of their words, folded and mixed."""

    def __init__(self, words: int):
        self.words = words
        self._known = _Words()

    def hashes(self, text: str) -> np.ndarray:
        """The unsigned hash of each shingle, in order, repeats included; a text of fewer words is one, a blank one none."""
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        each = np.fromiter(map(self._known.__getitem__, tokens), np.uint64, len(tokens))
        size = min(self.words, len(tokens))
        count = len(tokens) - size + 1
        found = np.full(count, size, np.uint64)
        for i in range(size):
            found = found * _MIX[0] + each[i : i + count]
        for factor in _MIX[1:]:
            found = (found ^ (found >> np.uint64(33))) * factor
        return found ^ (found >> np.uint64(33))

    def set(self, text: str) -> np.ndarray:
        """The different shingle hashes as signed numbers, in one fixed order."""
        return np.unique(self.hashes(text)).view(np.int64)


def set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def prefix_length(n: int, least: Fraction) -> int:
    return n - math.ceil(n * least) + 1 if n else 0


def share_of(least: float) -> Fraction:
    return Fraction(str(least))


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that many of the sampled texts hold, the most frequent last."""
    shingler = Shingler(words)

    def per_batch(batch: pa.RecordBatch) -> dict:
        sets = [shingler.set(t) for t in texts(batch)]
        return {"shingle": pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())}

    some = docs.select(text_of().alias("text")).where(F.pmod(F.xxhash64("text", F.lit(SAMPLE)), F.lit(SAMPLE)) == 0)
    counts = map_batches(some, per_batch, "shingle long").groupBy("shingle").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()
    return np.array([r["shingle"] for r in reversed(rows)], np.int64)


def marks(docs: DataFrame, words: int, least: float, fingerprint=None) -> DataFrame:
    """(doc_id, text_hash, fp, set_id, n, lead, prefix, rare, below), a row for each row of docs.

    set_id stands for the text's shingle set of n, lead is its smallest hash; prefix has its first shingles in order, of which so many
    are rare. below[k] counts its rare shingles in the first k of CELLS steps of the hash, as far as all of them are in the prefix.
    fp is fingerprint(hashes), or null without one.
    """
    ranked = frequent(docs, words)
    order = np.argsort(ranked)
    values = ranked[order]
    share = share_of(least)
    shingler = Shingler(words)
    steps = np.array([-(1 << 63) + k * (1 << 64) // CELLS for k in range(CELLS)], np.int64)  # where each step begins

    def prefix(found: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
        found = np.sort(found)
        often = np.zeros(len(found), bool)
        if len(values):
            at = np.minimum(np.searchsorted(values, found), len(values) - 1)
            often = values[at] == found
        size = prefix_length(len(found), share)
        rare = found[~often]
        if len(rare) >= size:
            known = rare[:size]
            ended = int(np.searchsorted(steps, known[-1], "right")) - 1 if size else 0  # the last step may go on
            return known, size, np.searchsorted(known, steps[: ended + 1], "left")
        rest = found[often]
        rest = rest[np.argsort(order[at[often]], kind="stable")][: size - len(rare)]
        return np.concatenate([rare, rest]), len(rare), np.append(np.searchsorted(rare, steps, "left"), len(rare))

    def per_batch(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("fp", "set_id", "n", "lead", "prefix", "rare", "below")}
        for text in texts(batch):
            hashes = shingler.hashes(text)
            found = np.unique(hashes).view(np.int64)
            out["lead"].append(int(found[0]) if len(found) else None)
            out["fp"].append(fingerprint(hashes) if fingerprint else None)
            out["set_id"].append(set_id(found))
            out["n"].append(len(found))
            for name, value in zip(("prefix", "rare", "below"), prefix(found), strict=True):
                out[name].append(value)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), **out}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    schema = "doc_id long, text_hash long, fp long, set_id long, n int, lead long, prefix array<long>, rare int, below array<int>"
    return map_batches(rows, per_batch, schema, rows=1024)


def grouped(marked: DataFrame, members: int = MEMBERS, tokens: int = TOKENS) -> DataFrame:
    """(set_id, n, text_hash, prefix, rare, below, group): each different set that isn't empty, once.

    Sets of one lead make a group; where there are more than `members` of them, or more
    than `tokens` shingles in all, they are dealt over as many groups as keep within that.
    """
    sets = written(
        marked.where("n > 0").groupBy("set_id").agg(
            F.first("n").cast("long").alias("n"), F.min("text_hash").alias("text_hash"),
            *[F.first(c).alias(c) for c in ("lead", "prefix", "rare", "below")],
        ),
        "groups-sets",
    )
    large = sets.groupBy("lead").agg(
        F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / tokens)).cast("long").alias("cuts")
    ).where("cuts > 1")
    found = written(
        sets.join(large, "lead", "left").select(
            "set_id", "n", "text_hash", "prefix", "rare", "below",
            F.xxhash64("lead", F.pmod(F.xxhash64("set_id"), F.coalesce("cuts", F.lit(1)))).alias("group"),
        ),
        "groups-members",
    )
    discard(sets)
    return found


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(shingle, n, set_id, group, place, often, before, before_n): prefix shingles that more than one set has.

    Rows are range-sorted by (shingle, n, set_id), so a frequent shingle is spread over tasks. before
    is the set ahead under the same shingle. Rows at the ends of a task are kept, as their like may be in the next.
    """
    names = ("shingle", "n", "set_id", "group", "place", "often")
    rows = sets.select("n", "set_id", "group", "rare", F.posexplode("prefix").alias("place", "shingle")).select(
        "shingle", "n", "set_id", "group", "place", (F.col("place") >= F.col("rare")).cast("int").alias("often")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((9, 0), np.int64)  # the last row: its columns, whether it follows its like, the set before it, and that one's size

        def out(done: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            kept = done[:, keep]
            first = kept[6] == 0
            columns = [*(pa.array(c, pa.int64()) for c in kept[:6]), *(pa.array(c, pa.int64(), mask=first) for c in kept[7:])]
            return pa.RecordBatch.from_arrays(columns, names=[*names, "before", "before_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            both = np.concatenate([held[:6], new], axis=1)
            alike = both[0, 1:] == both[0, :-1]
            tail = [np.concatenate([held[i] if held.shape[1] else [0], x]).astype(np.int64) for i, x in ((6, alike), (7, both[2, :-1]), (8, both[1, :-1]))]
            done = np.vstack([both, *tail])
            keep = (done[6, :-1] == 1) | alike
            if not held.shape[1] and len(keep):
                keep[0] = True
            if len(keep):
                yield out(done[:, :-1], keep)
            held = done[:, -1:]
        if held.shape[1]:
            yield out(held, np.array([True]))

    return (
        rows.repartitionByRange(*names[:3]).sortWithinPartitions(*names[:3])
        .mapInArrow(run, "shingle long, n long, set_id long, group long, place long, often long, before long, before_n long")
    )


def neighbours(shared: DataFrame, least: float) -> DataFrame:
    """(set_id, dst): of each set, the one that is ahead of it under most shingles, if these are about as many as alike sets share.

    Only a first choice: what it leaves out is found by qualifying().
    """
    share = share_of(least)
    pairs = shared.where("before IS NOT NULL").groupBy("set_id", F.col("before").alias("dst")).agg(
        F.count("*").alias("c"), F.first("n").alias("n"), F.first("before_n").alias("m")
    )
    beyond = F.least(*[F.ceil(F.col(x) * float(share) - 1e-9) - 1 for x in ("n", "m")])
    need = (F.col("n") + F.col("m")) * float(share / (1 + share)) - beyond
    return pairs.where(F.col("c") * 2 >= need).groupBy("set_id").agg(F.max(F.struct("c", "dst")).alias("best")).select("set_id", "best.dst")


def qualifying(shared: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(set_id, group): groups that a set has to open after the first round, each once.

    The token-group matrix has a row for each shingle, group and component in it. Of two groups the
    one with the larger id is asked for by the other's sets only, as a link is found from either side.
    """
    rooted = shared.join(roots, "set_id", "left").select(
        "shingle", "n", "set_id", "group", "place", "often", F.coalesce("root", "set_id").alias("root")
    )
    open_ones = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("shingle")
    rooted = written(rooted.join(open_ones, "shingle", "left_semi"), "groups-open")
    matrix = rooted.groupBy("shingle", F.col("group").alias("with_group"), F.col("root").alias("with_root")).agg(
        F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("place")).alias("rest")
    )
    share = share_of(least)
    up, down = int(share.numerator), int(share.denominator)
    half = float(share / (1 + share))
    # what the query and the smallest set of the group that can be alike to it at all must have in common
    common = (F.col("n") + F.greatest(F.col("least_n").cast("double"), F.ceil(F.col("n") * up / down - 1e-9).cast("double"))) * half - 1e-6
    met = rooted.join(matrix, "shingle").where(
        (F.col("group") <= F.col("with_group")) & (F.col("root") != F.col("with_root"))
        & (F.col("most_n") * down >= F.col("n") * up) & (F.col("n") * down >= F.col("least_n") * up)
        & ((F.col("often") == 0) | (F.least(F.col("n") - F.col("place"), F.col("rest")) >= common))
    )
    counted = met.groupBy("set_id", "with_group", "with_root").agg(
        F.count(F.when(F.col("often") == 0, 1)).alias("c"), F.max("often").alias("often"), F.min("least_n").alias("least_n")
    )
    sizes = sets.select("set_id", "n", "below")
    reach = sets.groupBy("group").agg(F.min(F.size("below") - 1).alias("reach"))
    reach = sets.join(reach, "group").groupBy(F.col("group").alias("with_group"), "reach").agg(
        F.max(F.col("n") - F.element_at("below", F.col("reach") + 1)).alias("beyond")
    )
    joined = counted.join(sizes, "set_id").join(reach, "with_group")
    own = F.size("below") - 1
    mine = F.col("n") - F.element_at("below", F.least(own, "reach") + 1)
    either = F.when(own >= F.col("reach"), F.least(mine, "beyond")).otherwise(mine)
    return joined.where((F.col("often") > 0) | (F.col("c") + either >= common)).select(
        "set_id", F.col("with_group").alias("group")
    ).distinct()


class OpenGroup:
    """The members of one group, and the links of its members and of queries to them."""

    def __init__(self, least: Fraction):
        self.least, self.ids, self.sets = least, [], []
        self._tokens = None

    def add(self, member: int, found: np.ndarray) -> None:
        self.ids.append(member)
        self.sets.append(found)

    def _index(self) -> None:
        self._sizes = np.array([len(s) for s in self.sets], np.int64)
        tokens = np.concatenate(self.sets) if self.sets else np.empty(0, np.int64)
        order = np.argsort(tokens, kind="stable")
        self._tokens = tokens[order]
        self._owner = np.repeat(np.arange(len(self.sets)), self._sizes)[order]
        self._root = np.arange(len(self.sets))

    def _alike(self, found: np.ndarray) -> np.ndarray:
        """The members alike to a set: all intersections are counted at once."""
        low = np.searchsorted(self._tokens, found, "left")
        count = np.searchsorted(self._tokens, found, "right") - low
        low, count = low[count > 0], count[count > 0]
        if not len(low):
            return np.empty(0, np.int64)
        at = np.arange(int(count.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        shared = np.bincount(self._owner[at], minlength=len(self.sets))
        either = len(found) + self._sizes - shared
        return np.flatnonzero(shared * self.least.denominator >= either * self.least.numerator)

    def own_links(self) -> list[tuple[int, int]]:
        """Enough links between members to join all that are alike."""
        if self._tokens is None:
            self._index()
        found = []
        for i in range(1, len(self.sets)):
            near = self._alike(self.sets[i])
            near = near[near < i]
            roots, first = np.unique(self._root[near], return_index=True)
            found += [(self.ids[i], self.ids[near[k]]) for k in first.tolist()]
            if len(roots):
                self._root[np.isin(self._root, roots)] = roots[0]
                self._root[i] = roots[0]
        return found

    def query(self, other: int, found: np.ndarray) -> list[tuple[int, int]]:
        """A link to each component of members that has one alike."""
        if self._tokens is None:
            self._index()
        near = self._alike(found)
        roots, first = np.unique(self._root[near], return_index=True)
        return [(other, self.ids[near[i]]) for i in first.tolist()]


def opened(
    openings: DataFrame, own: DataFrame | None, sets: DataFrame, docs: DataFrame, words: int, least: float, queries: int = QUERIES
) -> DataFrame:
    """(src, dst): exact links that opening groups finds, for openings (set_id, group), each once, written.

    The groups in own (group) are opened to their own members as well. A group asked for by more than `queries` sets
    goes to several tasks with a part of them each.
    """
    parts = openings.groupBy("group").agg(F.ceil(F.count("*") / queries).cast("long").alias("parts"), F.lit(0).alias("own"))
    if own is not None:
        parts = parts.union(own.select("group", F.lit(1).cast("long"), F.lit(1)))
    parts = written(parts.groupBy("group").agg(F.max("parts").alias("parts"), F.max("own").alias("own")), "groups-parts")
    home = sets.select("set_id", "text_hash", "group")
    members = home.join(parts, "group").select(
        "group", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.when(F.col("own") == 1, 0).otherwise(1).alias("kind"), "set_id", "text_hash"
    )
    asking = (
        openings.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")))
        .join(home.select("set_id", "text_hash"), "set_id")
        .select("group", "part", F.lit(2).alias("kind"), "set_id", "text_hash")
    )
    rows = written(members.union(asking), "groups-rows")
    wanted = written(rows.select("text_hash").distinct(), "groups-texts")
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    found = docs.select(text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash")).join(keys, "text_hash", "left_semi")
    found = found.groupBy("text_hash").agg(F.first("text").alias("text"))
    share = share_of(least)
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, group, closed = Shingler(words), None, None, True
        for batch in batches:
            links: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("group", "part", "kind", "set_id")]
            for key, part, kind, member, text in zip(*columns, batch.column("text"), strict=True):
                if (key, part) != now:
                    if not closed:
                        links += group.own_links()
                    now, group, closed = (key, part), OpenGroup(share), kind > 0 or part > 0
                if kind < 2:
                    group.add(member, shingler.set(text.as_py()))
                    continue
                if not closed:
                    links += group.own_links()
                    closed = True
                links += group.query(member, shingler.set(text.as_py()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=schema)
        if not closed and (links := group.own_links()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], schema=schema)

    links = written(
        rows.join(found, "text_hash").select("group", "part", "kind", "set_id", "text")
        .repartition("group", "part").sortWithinPartitions("group", "part", "kind")
        .mapInArrow(compare, "src long, dst long"),
        "groups-links",
    )
    discard(parts, rows, wanted)
    return links


def roots_of(
    marked: DataFrame, docs: DataFrame, words: int, least: float, proposed: DataFrame | None = None,
    members: int = MEMBERS, tokens: int = TOKENS, queries: int = QUERIES,
) -> DataFrame:
    """(set_id, root): sets with a link to another one, and the set that stands for their component.

    marked is what marks() gives for docs, written. proposed (src, dst) names sets that may be alike;
    they are compared in the first round, and the result is the same with or without them.
    """
    sets = grouped(marked, members, tokens)
    shared = written(shared_tokens(sets), "groups-shared")
    pairs = neighbours(shared, least)
    if proposed is not None:
        pairs = pairs.union(proposed.select(F.col("src").alias("set_id"), "dst"))
    homes = sets.select(F.col("set_id").alias("dst"), "group")
    placed = written(
        pairs.distinct().join(homes, "dst").join(sets.select("set_id", F.col("group").alias("home")), "set_id").select("set_id", "group", "home").distinct(),
        "groups-first",
    )
    first, own = placed.where("group != home").select("set_id", "group"), placed.where("group = home").select("group").distinct()
    sure = opened(first, own, sets, docs, words, least, queries)
    stars = components(sure).select(F.col("node").alias("set_id"), "root")
    settled = first.union(sets.join(own, "group", "left_semi").select("set_id", "group"))
    second = written(qualifying(shared, stars, sets, least).join(settled, ["set_id", "group"], "left_anti"), "groups-second")
    discard(shared)
    rest = opened(second, None, sets, docs, words, least, queries)
    discard(sets, placed, second)
    return components(sure.union(rest)).select(F.col("node").alias("set_id"), "root")


def jaccard_join(
    docs: DataFrame, words: int = 5, least: float = 0.8, members: int = MEMBERS, tokens: int = TOKENS, queries: int = QUERIES
) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Two texts are linked where their sets of `words`-word shingles have a Jaccard likeness of `least`
    or more; component_id is the smallest doc_id that links reach. A text of fewer words is one shingle.
    A null or blank text has no shingles and no links: its component is its own id. A null id is never
    the smallest; a component of null ids only has a null one. Repeated rows come out repeated, other
    columns are not read, and an empty table gives an empty one.
    """
    marked = written(marks(docs, words, least), "groups-marks")
    roots = roots_of(marked, docs, words, least, None, members, tokens, queries)
    rooted = marked.join(roots, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "set_id").alias("root")
    )
    rooted = written(rooted, "groups-documents")
    ids = rooted.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = rooted.where("n_shingles > 0").join(ids, "root").select("doc_id", "n_shingles", "component_id")
    return full.union(rooted.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
