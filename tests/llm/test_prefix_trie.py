"""The trie of conversation prefixes and what it is made of, against plain loops."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from hearthbook.llm import common, list_ranking, prefix_trie, scans
from hearthbook.llm.oracles import OP11
from hearthbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in said.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in said:
        h = 0 if c % 5 == 0 else zlib.crc32(str(c).encode()) % 9
        turns = tuple(said.get(c - c % 5, [])[:h] + said[c][h:])
        for k in range(len(turns) + 1):
            members[turns[:k]].append(c)
        ends[turns].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, convs in members.items():
        for k in range(len(key) + 1):
            leaves[key[:k]] += key not in children
            saved[key[:k]] += (len(convs) - 1) * len(key[-1][1].encode()) if key else 0
    return sorted(
        (
            min(convs), len(key), min(members[key[:-1]]) if key else -1, len(convs), children[key], leaves[key], saved[key],
            hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest(),
        )
        for key, convs in members.items()
    )


def got(frame):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in frame.select(COLUMNS).collect())


def plain(frame):
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in frame.select("conv_id", "turn", "role", "text").collect()]


def test_trie_of_the_table_and_its_sql(spark):
    table = common.table(spark, SF, "conversations")
    found = got(QUERIES["op11_prefix_trie"](spark, SF))
    assert found == brute(plain(table))
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
        rows = duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP11})").fetchall()
    assert found == sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rows)


@pytest.fixture(scope="module")
def odd(spark):
    """A conversation of many turns, one first turn for most, equal conversations, repeated rows, gaps and nulls."""
    rng = np.random.default_rng(5)
    rows = [(2, i, "user", f"t{i % 7}") for i in range(700)]
    for c in range(10, 150):
        rows += [(c, 0, "system", "all alike")] + [(c, k, "user", str(rng.integers(0, 3))) for k in range(1, int(rng.integers(1, 5)))]
    rows += [(c, k, "user", "same") for c in range(200, 260) for k in range(3)]
    rows += [(3, None, None, None), (3, None, "user", "é"), (3, 1, "user", ""), (3, 1, "user", ""), (None, 0, "user", "nobody")]
    rows += [(7_000_000_001, 0, "user", "no lender"), (4, 1, "user", "long " * 20_000)]
    return spark.createDataFrame([(*r, 9, "x") for r in rows], "conv_id long, turn int, role string, text string, depth int, place string")


def test_trie_of_odd_conversations(spark, odd):
    wanted = brute(plain(odd))
    assert got(prefix_trie.prefix_trie(odd)) == wanted
    assert got(prefix_trie.prefix_trie(odd.repartition(13), block=16, at_once=8)) == wanted
    assert prefix_trie.prefix_trie(odd.limit(0)).count() == 0
    assert prefix_trie.prefix_trie(odd.where("conv_id IS NULL")).count() == 0


def test_nodes_can_have_their_texts(spark, odd):
    some = odd.where("conv_id BETWEEN 10 AND 14")
    rows = prefix_trie.prefix_trie(some, with_text=True).collect()
    assert {(r["role"], r["text"]) for r in rows if r["depth"] == 1} == {("system", "all alike")}
    assert [(r["role"], r["text"]) for r in rows if r["depth"] == 0] == [(None, None)]


def test_digests_of_ends_in_pieces(spark):
    ends = spark.range(5000).selectExpr("CASE WHEN id < 4000 THEN 1 ELSE id % 50 + 2 END AS id", "id * 3 AS conv_id")
    wanted = defaultdict(list)
    for r in ends.collect():
        wanted[r["id"]].append(r["conv_id"])
    wanted = {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in wanted.items()}
    for piece in (1, 64, prefix_trie.PIECE):
        assert {r["id"]: r["ends_sha256"] for r in prefix_trie.end_digests(ends, piece).collect()} == wanted


@pytest.mark.parametrize(("block", "at_once"), [(7, 5), (1, 3), (64, 1000), (100_000, 1)])
def test_lists_are_ranked(spark, block, at_once):
    rng = np.random.default_rng(block)
    ids = rng.permutation(3000).tolist()
    lists = [ids[:1], ids[1:40], ids[40:]]
    links = [(a, b) for part in lists for a, b in zip(part, [*part[1:], None], strict=True)]
    frame = spark.createDataFrame(links, "arc long, next long").repartition(9)
    found = {r["arc"]: r["position"] for r in list_ranking.list_ranks(frame, block, max(at_once, 3)).collect()}
    assert found == {a: k for part in lists for k, a in enumerate(part)}
    assert list_ranking.list_ranks(frame.limit(0), block).count() == 0


def test_running_totals_over_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), i, int(v), int(x)) for i, (g, v, x) in enumerate(zip(rng.choice([1, 1, 1, 2, 3, 9], 2000), rng.integers(-9, 9, 2000), rng.integers(-2**62, 2**62, 2000), strict=True))]
    frame = spark.createDataFrame(rows, "g long, i long, v long, x long").repartition(11)
    for group in ("g", None):
        total, mixed = defaultdict(int), defaultdict(int)
        wanted = {}
        for g, i, v, x in rows:
            key = g if group else 0
            total[key] += v
            mixed[key] ^= x
            wanted[i] = (total[key], mixed[key])
        found = scans.running(frame, group, ["i"], sums=["v"], xors=["x"]).collect()
        assert {r["i"]: (r["v_run"], r["x_run"]) for r in found} == wanted
    assert scans.running(frame.limit(0), "g", ["i"], sums=["v"]).count() == 0
