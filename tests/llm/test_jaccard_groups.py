"""The Jaccard join against all pairs compared one by one."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import numpy as np
import pytest

from hearthbook.llm import common, jaccard_groups
from hearthbook.llm.oracles import OP13
from hearthbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Sorted (doc_id, n_shingles, component_id) of (doc_id, text) rows; rows are told apart by their place."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        size = min(5, len(words))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set())
    parents = list(range(len(rows)))

    def root(i):
        while parents[i] != i:
            i = parents[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parents[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[root(i)].append(doc_id)
    found = [(d, len(sets[i]), min((x for x in ids[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]
    return sorted(found, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_join_of_the_table_and_its_sql(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    found = got(QUERIES["op13_jaccard_groups"](spark, SF))
    assert found == brute(rows)
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        assert found == sorted(duck.execute(f"SELECT doc_id, n_shingles, component_id FROM ({OP13})").fetchall(), key=repr)


@pytest.fixture(scope="module")
def crowd():
    """A third of all rows in one dense cluster, chains of copies, shared passages, short and odd texts."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choice(vocabulary, 60).tolist()
    texts = []
    for _ in range(160):
        words = list(base)
        words[int(rng.integers(0, 60))] = str(rng.choice(vocabulary))
        texts.append(" ".join(words))
    chain = rng.choice(vocabulary, 80).tolist()
    for k in range(60):
        chain[k] = f"new{k}"
        texts.append(" ".join(chain))
    passage = " ".join(rng.choice(vocabulary, 50))
    texts += [passage + " " + " ".join(rng.choice(vocabulary, int(rng.integers(1, 40)))) for _ in range(120)]
    texts += [" ".join(rng.choice(vocabulary, int(rng.integers(1, 30)))) for _ in range(60)]
    texts += ["one two", "ONE  two", "one", None, "", " \n", "É x y", "é x y", "long text " * 20_000, "a b c d e", "a b c d e f", "a b c d e a b c d e"]
    rows = list(enumerate(texts)) + [(None, "one two"), (None, None), (7, texts[7]), (7, texts[7]), (None, "nobody else says this at all")]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@pytest.mark.parametrize("limits", [{}, {"members": 3, "tokens": 10_000, "queries": 5}, {"members": 1}])
def test_join_of_a_crowd(spark, crowd, limits):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in crowd], "doc_id long, text string, n int, set_id string").repartition(9)
    assert got(jaccard_groups.jaccard_join(frame, **limits)) == brute(crowd)
    assert jaccard_groups.jaccard_join(frame.limit(0), **limits).count() == 0
    assert got(jaccard_groups.jaccard_join(frame.where("text IS NULL"), **limits)) == brute([r for r in crowd if r[1] is None])


def test_likeness_at_the_border(spark):
    for n in (4, 9, 14, 40):  # n + 4 words have n shingles
        a = [f"a{i}" for i in range(n + 4)]
        for cut in range(1, 12):
            rows = [(1, " ".join(a)), (2, " ".join(a + [f"b{i}" for i in range(cut)]))]
            frame = spark.createDataFrame(rows, "doc_id long, text string")
            if cut in (n // 4, n // 4 + 1):
                assert got(jaccard_groups.jaccard_join(frame)) == brute(rows)


def test_few_texts_are_opened(spark, crowd):
    """A dense cluster isn't compared pair by pair: openings stay near the number of its sets."""
    frame = spark.createDataFrame([(i, t) for i, t in crowd], "doc_id long, text string")
    marked = common.written(jaccard_groups.marks(frame, 5, 0.8), "test-marks")
    sets = jaccard_groups.grouped(marked, members=4)
    shared = common.written(jaccard_groups.shared_tokens(sets), "test-shared")
    first = jaccard_groups.neighbours(shared, 0.8)
    assert 150 < first.count() <= sets.count()
    roots = jaccard_groups.roots_of(marked, frame, 5, 0.8, None, members=4)
    assert jaccard_groups.qualifying(shared, roots, sets, 0.8).count() < 40


def test_shingles_of_few_words_differ_from_longer_ones():
    shingler = jaccard_groups.Shingler(5)
    assert len(shingler.hashes("a b c d e f")) == 2 and len(shingler.hashes("a b")) == 1 and not len(shingler.hashes(" \n"))
    assert set(shingler.hashes("a b c d").tolist()).isdisjoint(shingler.hashes("a b c d e").tolist())
    assert (shingler.hashes("A b\tC") == shingler.hashes("a  B c\n")).all()
