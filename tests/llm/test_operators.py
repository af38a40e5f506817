"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from hearthbook.llm import (
    byte_bpe, common, components, decontamination, edit_embedding, katz, merkle_fixity, near_copies, pii, quality_knn, simhash,
    simple8b, toxicity_mil,
)
from hearthbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
EDGES = [(-5, None), (-4, ""), (-3, "   \n"), (-2, "Word"), (None, "no id"), (-1, "é🙂 " * 3000), (7, "twice"), (7, "twice")]


@cache
def _texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, "clash", 1.0, "x") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, score double, ids string")


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.limit(0)


def rows_of(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}


def shingles(text, size, lower=str.lower):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)], words


# ---- 1


def test_audit_finds_what_was_damaged_and_nothing_else(spark):
    pages = common.table(spark, SF, "pages")
    records = merkle_fixity.archived(pages)
    found = {(r["page_id"], r["status"]) for r in QUERIES["op1_merkle_fixity"](spark, SF).collect()}
    status = {7: "changed", 19: "missing", 31: "unexpected"}
    ids = [r["page_id"] for r in pages.select("page_id").collect()]
    assert found == {(i, status[t]) for i in ids if (t := zlib.crc32(str(i).encode()) % 128) in status}
    assert merkle_fixity.audit(records, records).count() == 0
    assert merkle_fixity.audit(records, records.limit(0)).count() == records.count()
    assert merkle_fixity.audit(records.limit(0), records.limit(0)).count() == 0


def test_offsets_follow_the_records_of_an_archive(spark):
    pages = spark.createDataFrame([(1, "u", "é"), (2, None, None), (2, None, None), (None, "v", "x")], "page_id long, url string, html string")
    rows = sorted((r["archive"], r["offset"], r["page_id"]) for r in merkle_fixity.archived(pages).collect())
    first = len("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode())
    assert rows[0] == (-1, 0, -1) and rows[1] == (0, 0, 1) and rows[2] == (0, first, 2) and len(rows) == 4


def test_offsets_of_repeated_and_odd_records(spark):
    """A third of the records repeat one page, others have no id; long pages and clashing names too."""
    rows = [(5, "u", "same")] * 300 + [(None, "v", f"x{i % 7}") for i in range(200)] + [(i, "w", "y" * (i % 50)) for i in range(400)] + [(900, "z", "é" * 300_000)]
    names = "page_id long, url string, html string, archive string, offset string, record_hash string, level int"
    pages = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], names).repartition(11)
    records = merkle_fixity.archived(pages).collect()
    assert len(records) == len(rows)

    def length(page_id, url, html):
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nContent-Length: {len(html.encode())}\r\n\r\n"
        return len((head + html + "\r\n\r\n").encode())

    sizes = {}
    for page_id, url, html in rows:
        page_id = -1 if page_id is None else page_id
        sizes.setdefault(page_id // 256, []).append(length(page_id, url, html))
    for archive, found in sizes.items():
        offsets = sorted(r["offset"] for r in records if r["archive"] == archive)
        assert offsets[0] == 0 and len(set(offsets)) == len(found)
        gaps = [b - a for a, b in zip(offsets, offsets[1:], strict=False)]
        last = sorted(found)
        for gap in gaps:
            last.remove(gap)
        assert len(last) == 1
    frame = merkle_fixity.archived(pages)
    assert merkle_fixity.audit(frame, frame).count() == 0


# ---- 2 and 9


def test_byte_bpe_is_what_tiktoken_gives(spark, edges, nothing):
    import tiktoken

    path, pattern = byte_bpe.default_path(), byte_bpe.default_pattern()
    ranks, halves = byte_bpe.vocabulary(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for doc_id, row in rows_of(spark, "op2_byte_bpe").items():
        ids = library.encode_ordinary(_texts(spark)[doc_id])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(_texts(spark)[doc_id].encode()).hexdigest()
    codec = byte_bpe.Codec(ranks, halves, pattern)
    rng = np.random.default_rng(3)
    for _ in range(400):
        text = "".join(rng.choice(list("abcdeé \n\t.'s1漢🙂 tThE　"), size=rng.integers(0, 50)))
        assert codec.encode(text) == library.encode_ordinary(text)
        assert "".join(byte_bpe.units(text)) == text
        assert byte_bpe.decode_ids(codec.bytes_of, np.array(codec.encode(text), int)).decode() == text
    coded = byte_bpe.decode(byte_bpe.encode(edges, path, pattern), path)
    assert sorted(str(bytes(r["decoded"]).decode()) for r in coded.collect()) == sorted(t or "" for _, t in EDGES)
    assert byte_bpe.round_trip(nothing, path, pattern).count() == 0


def test_simple8b_files_hold_the_ids_in_order(spark, edges, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(simple8b.default_tokenizer())
    start, found = 0, rows_of(spark, "op9_simple8b")
    for doc_id, text in sorted(_texts(spark).items()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        row = found[doc_id]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    stored = simple8b.stored_ids(edges, simple8b.default_tokenizer()).collect()
    assert len(stored) == len(EDGES) and min(r["start"] for r in stored) == 0
    assert next(r["start"] for r in stored if r["doc_id"] is None) == 0
    assert simple8b.stored_ids(nothing, simple8b.default_tokenizer()).count() == 0


def test_shards_split_a_third_of_equal_rows(spark):
    rows = [(None, "no id at all")] * 400 + [(5, f"text {i}") for i in range(400)] + [(i, "x y") for i in range(10, 410)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    path = common.new_path(spark, "ids-of-equal-rows")
    simple8b.write_ids(docs, simple8b.default_tokenizer(), path)
    per_shard = [r["n"] for r in spark.read.parquet(path).groupBy("shard").agg({"ids": "sum"}).withColumnRenamed("sum(ids)", "n").collect()]
    assert len(per_shard) == 4 and max(per_shard) < 2 * sum(per_shard) / 4
    stored = sorted(simple8b.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert len(stored) == len(rows) and [r["doc_id"] is None for r in stored] == [True] * 400 + [False] * 800
    ids = [r["doc_id"] for r in stored[400:]]
    assert ids == sorted(ids) and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(stored, stored[1:], strict=False))


def test_tokenizer_by_units_is_the_library_as_it_loads(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(simple8b.default_tokenizer())
    with open(simple8b.default_tokenizer(), encoding="utf-8") as file:
        own = simple8b._Tokenizer(file.read())
    rng = np.random.default_rng(9)
    parts = ["a", "word", "Word", " ", "  ", "\n", "\t", ".", ",", "!?", "'s", "'ll", "1", "2024", "é", "ß", "漢字", "🙂", "\u00a0", "\u3000", "\u2028", "\x1c", "\x85",
             "ǅ", "ª", "²", "_", "-", "x" * 40, "<|endoftext|>", "<|end", "of", "\u0301", "\ufeff", "ʰ", "Ⅷ"]
    texts = ["a<|endoftext|>b", " <|endoftext|> ", "", " ", *("".join(rng.choice(parts, int(rng.integers(1, 14)))) for _ in range(4000))]
    for text, found in zip(texts, own.encode(texts), strict=True):
        assert found.tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text
    docs = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string")
    counts = {r["doc_id"]: r["n_tokens"] for r in simple8b.stored_ids(docs, simple8b.default_tokenizer()).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts[:50])}


def test_other_definitions_go_to_the_library_as_they_are():
    import json

    from tokenizers import Tokenizer

    with open(simple8b.default_tokenizer(), encoding="utf-8") as file:
        said = json.load(file)
    said["normalizer"] = {"type": "Lowercase"}
    own, library = simple8b._Tokenizer(json.dumps(said)), Tokenizer.from_str(json.dumps(said))
    for text in ("Some WORDS here", " Ünd  so"):
        assert own.encode([text])[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert not own.by_units


def test_simple8b_packs_any_numbers():
    rng = np.random.default_rng(1)
    for turn in range(60):
        n = int(rng.integers(0, 9000))
        values = rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        if turn % 7 == 0:
            values |= np.uint64(1 << 63)
        payload = simple8b.write_segment([1], [values])
        assert (simple8b.read_segment(payload)[2] == values).all()
        if n:
            k = int(rng.integers(0, -(-n // simple8b.BLOCK)))
            assert (simple8b.read_block(payload, k) == values[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


# ---- 3


def test_edit_embedding_compares_neighbours(spark, edges, nothing):
    found = rows_of(spark, "op3_edit_embedding")
    ids = sorted(_texts(spark))
    walker = edit_embedding.Walker()
    for i, doc_id in enumerate(ids):
        text, following = _texts(spark)[doc_id], _texts(spark)[ids[(i + 1) % len(ids)]]
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        row = found[doc_id]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        mark, other, near = map(walker.fingerprint, (text, changed, following))
        assert row["fingerprint"] == mark.hex() and row["edited_fingerprint"] == other.hex()
        assert row["near_edited"] == edit_embedding.likeness(mark, other) and row["near_next"] == edit_embedding.likeness(mark, near)
        assert row["near_edited"] > row["near_next"] or text == following
    assert edit_embedding.with_neighbours(edges).count() == len(EDGES)
    assert edit_embedding.with_neighbours(nothing).count() == 0


def test_edit_embedding_survives_insertions_and_links_classes(spark):
    base = [_texts(spark)[i] for i in sorted(_texts(spark))[:12]]
    walker = edit_embedding.Walker()
    changed = [t[:40] + "xyz" + t[40:] for t in base]
    assert np.mean([edit_embedding.likeness(walker.fingerprint(a), walker.fingerprint(b)) for a, b in zip(base, changed)]) > 0.6
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*base, *(t[:-1] for t in base)])], "doc_id long, text string")
    prints = {r["doc_id"]: bytes.fromhex(r["fingerprint"]) for r in edit_embedding.fingerprints(docs).collect()}
    classes = {r["doc_id"]: r["class_id"] for r in edit_embedding.near_duplicates(docs).collect()}
    for i, a in prints.items():
        for j, b in prints.items():
            if edit_embedding.likeness(a, b) >= 0.9:
                assert classes[i] == classes[j]
    assert len(set(classes.values())) >= 8


@pytest.mark.parametrize("block", [8, 1024])
def test_band_links_miss_no_pair(spark, block):
    rng = np.random.default_rng(block)
    marks = []
    for _ in range(40):
        one = rng.integers(0, 256, edit_embedding.SAMPLES, np.uint8)
        # 25 differing samples, spread over all residues of 16; then one too many
        places = rng.permutation(16) + 16 * rng.integers(0, 8, 16)
        places = np.append(places, rng.permutation(np.setdiff1d(np.arange(edit_embedding.SAMPLES), places))[:10])
        near, far = one.copy(), one.copy()
        near[places[:25]] += 1
        far[places] += 1
        marks += [one, near] if rng.random() < 0.5 else [one, far]
    prints = {i: m.tobytes() for i, m in enumerate(marks)}
    frame = spark.createDataFrame([(p.hex(),) for p in prints.values()], "fingerprint string")
    links = edit_embedding.band_links(frame, 0.8, block=block).collect()
    found = {frozenset((r["src"], r["dst"])) for r in links}
    assert found == {frozenset((a.hex(), b.hex())) for i, a in prints.items() for j, b in prints.items()
                     if i < j and edit_embedding.likeness(a, b) >= 0.8}
    assert 0 < len(found) < 40


# ---- 4 and 5


def auc(truth, scores):
    order = np.argsort(np.argsort(scores))
    truth = np.array(truth, bool)
    return (order[truth].sum() - truth.sum() * (truth.sum() - 1) / 2) / (truth.sum() * (~truth).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity_mil", "toxic", 0.9), ("op5_quality_knn", "quality", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    larger = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r[label] for r in common.table(spark, larger, "labels").collect()}
    rows = QUERIES[name](spark, larger).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert auc([known[r["doc_id"]] for r in held], [r["score"] for r in held]) > least


def test_classifiers_without_rows_or_labels(spark, edges, nothing):
    labels = spark.createDataFrame([(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for score in (toxicity_mil.toxicity_scores, quality_knn.quality_scores):
        assert score(edges, labels).count() == len(EDGES)
        assert score(nothing, labels).count() == 0
    assert quality_knn.of_quality(edges, labels).columns == edges.columns


def test_noisy_or_of_sentences_and_places():
    weights = toxicity_mil.Weights(["bad"], np.array([9.0]), -4.0)
    score, found = weights.judge("All is well. This is bad! Fine.")
    chances = [1 / (1 + math.exp(4)), 1 / (1 + math.exp(-5)), 1 / (1 + math.exp(4))]
    assert score == pytest.approx(1 - math.prod(1 - p for p in chances))
    assert [(a, b) for a, b, _ in found] == [(12, 25)]
    assert weights.judge("") == (0.0, [])


def test_votes_weigh_by_similarity():
    known, labels = np.eye(3, dtype=np.float32), np.array([1.0, 0.0, 1.0])
    near = np.array([[1, 0, 0], [0, 0, 0], [0.6, 0.8, 0]], np.float32)
    found = quality_knn.votes(near, known, labels, 2)
    assert found[0] == 1 and found[1] == pytest.approx(2 / 3) and found[2] == pytest.approx(0.6**8 / (0.6**8 + 0.8**8))


# ---- 6


def brute_items(texts, items):
    out = set()
    for doc_id, text in texts.items():
        have = set(shingles(text, 5)[0])
        for item_id, item in items.items():
            want = set(shingles(item, 5)[0])
            if want and 10 * len(want & have) >= 8 * len(want):
                out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_contained_items_are_all_found(spark, broadcast_rows):
    items = {r["item_id"]: r["text"] for r in common.table(spark, SF, "benchmark").collect()}
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    found = decontamination.contained_items(docs, bench, broadcast_rows=broadcast_rows)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute_items(_texts(spark), items)
    clean = {r["doc_id"] for r in decontamination.without_benchmark(docs, bench).collect()}
    assert clean == set(_texts(spark)) - {d for d, _ in brute_items(_texts(spark), items)}


def test_decontamination_edges(spark, edges, nothing):
    items = spark.createDataFrame([(1, None), (2, "four words are few"), (3, "a b c d e f"), (3, "a b c d e f")], "item_id long, text string")
    assert decontamination.contaminated(edges, items).count() == 0
    assert decontamination.contaminated(nothing, items).count() == 0
    assert decontamination.without_benchmark(edges, items.limit(0)).count() == len(EDGES)
    docs = spark.createDataFrame([(None, "x A b c d e f y"), (1, "a b c d e z f")], "doc_id long, text string")
    rows = decontamination.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in rows] == [(None, 3, 1.0)]


# ---- 7


@pytest.mark.parametrize(("hot", "dense"), [(katz.HOT, katz.DENSE), (50, 8)])
def test_katz_scores(spark, hot, dense):
    found = {r["doc_id"]: r for r in katz.scores(common.table(spark, SF, "documents"), hot, dense).collect()}
    tokens = {i: [*t.encode().lower().split(), "end"] for i, t in _texts(spark).items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    words, pairs = Counter(), Counter()
    for i, found_tokens in tokens.items():
        if not held[i]:
            words.update(found_tokens)
            pairs.update(zip(["start", *found_tokens], found_tokens))
    total = sum(words.values())
    keep = lambda d, r: d[r] if r <= katz.K else 1 - katz.TAIL
    d1, d2 = katz.discounts(Counter(words.values())), katz.discounts(Counter(pairs.values()))
    unknown = 1 - sum(keep(d1, r) * r for r in words.values()) / total
    single = lambda w: keep(d1, words[w]) * words[w] / total if words[w] else unknown
    size, kept, covered = Counter(), Counter(), Counter()
    for (u, v), r in pairs.items():
        size[u] += r
        kept[u] += keep(d2, r) * r
        covered[u] += single(v)

    def chance(u, v):
        if r := pairs.get((u, v)):
            return keep(d2, r) * r / size[u]
        return single(v) if not size[u] else (1 - kept[u] / size[u]) / (1 - covered[u]) * single(v)

    for u in ["start", *list(size)[:5]]:
        assert sum(chance(u, v) for v in words) + chance(u, "never seen") == pytest.approx(1)
    for i, found_tokens in tokens.items():
        row = found[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[i], len(found_tokens), total)
        assert row["n_known"] == sum(words[w] > 0 for w in found_tokens)
        assert row["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in found_tokens))
        assert row["score"] == pytest.approx(sum(math.log10(chance(u, v)) for u, v in zip(["start", *found_tokens], found_tokens)))


def test_katz_task_keeps_sums_only():
    """A task that is given 2.4 million positions holds sums of its documents and contexts, not the positions."""
    words = katz.Unigrams(10_000_000, 5_000, 1_000, {r: 100 for r in range(1, katz.K + 2)}, [b"a"], [900], [])
    task, size, out = katz._Task(words), 20_000, []
    rng = np.random.default_rng(3)
    given = known = 0
    tracemalloc.start()
    for i in range(120):
        v = np.sort((1 << 50) + 100 * i + rng.integers(0, 100, size))
        row = 2 * rng.integers(0, 1_000, size) + (rng.integers(0, 4, size) == 0)
        times = rng.integers(1, 4, size)
        seen = np.isin(v, v[row % 2 == 0])
        given, known = given + int(times[row % 2 == 0].sum()), known + int(times[seen].sum())
        out += task.work(v, rng.integers(0, 30, size), row * (katz._MOST + 1) + times)
        assert sum(part[0].size for part in task.parts) <= katz.SUMMED
    peak = tracemalloc.get_traced_memory()[1]
    out += task.flush()
    tracemalloc.stop()
    assert peak < 60 << 20 and max(batch.num_rows for batch in out) <= katz.BATCH
    rows = [r for batch in out for r in batch.to_pylist()]
    assert sum(r["c0"] for r in rows if r["kind"] == 1) == given
    assert sum(r["c0"] for r in rows if r["kind"] == 0) == known


def test_katz_edges(spark, edges, nothing):
    assert katz.scores(edges).count() == len(EDGES) and katz.scores(nothing).count() == 0
    lone = spark.createDataFrame([(next(i for i in range(99) if katz.is_held_out(i)), "only held out")], "doc_id long, text string")
    assert [(r["score"], r["train_tokens"], r["n_known"]) for r in katz.scores(lone).collect()] == [(0.0, 0, 0)]


# ---- 8


def base_spans(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def holds(kind, match):
        digits = re.sub("[^0-9]", "", match)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
                "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, text) if holds(k, m[0])]


def check_spans(rows, texts):
    for row, text in zip(rows, texts, strict=True):
        base = [f"{k}:{a}:{b}" for k, a, b in base_spans(text)]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text[:200]
        assert set(base) <= set(filter(None, row["spans"].split(",")))
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(f"{k}:") for b in base) for k in pii.KINDS]


def test_base_spans_of_documents(spark):
    found = rows_of(spark, "op8_pii")
    check_spans([found[i] for i in sorted(found)], [_texts(spark)[i] for i in sorted(found)])


def test_base_spans_of_odd_texts(spark, nothing):
    rng = np.random.default_rng(4)
    odd = ["", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1", "x" * 20000, "1" * 30000, "+" * 500, "a.b" * 5000 + "@x.y",
           "🙂 4111 1111 1111 1111 é +1 (729) 555-7725", "1-" * 9 + "1", "é a@b.c"]
    odd += ["".join(rng.choice(list("0123456789.@+-() ab_%é🙂"), size=rng.integers(1, 80))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    rows = sorted(pii.listed(docs).collect(), key=lambda r: r["doc_id"])
    check_spans(rows, odd)
    assert pii.listed(nothing).count() == 0


@pytest.mark.parametrize("share", [0.02, 0.1, 1 / 3])
def test_signless_spans_are_added_however_common(spark, share):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), 6))
    digits = lambda n: "".join(map(str, rng.integers(1, 10, n)))
    ways = [(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot ")]
    rows, planted = [], {}
    for i in range(900):
        phone = f"1 ({digits(3)}) {digits(3)}-{digits(4)}"
        text = f"{word()} {word()}, "
        if i % 4 == 0:
            text += f"{word()} +{phone} {word()}, {word()}.{digits(2)}@{word()}.{word()}.example, "
        if i % 4 == 1:
            card = digits(15)
            text += f'token = "{digits(3)}c0a{digits(8)}e{digits(9)}fb{digits(3)}" ' + card + str(next(d for d in range(10) if pii_luhn(card + str(d)) != 0)) + " "
        if rng.random() < share:
            at, dot = ways[i % 3]
            mail = f"{word()}.{digits(2)}{at}{word()}{dot}example"
            for kind, piece in (("phone", phone), ("email", mail)):
                text += f"{word()}: "
                planted.setdefault(i, []).append(f"{kind}:{len(text)}:{len(text) + len(piece)}")
                text += f"{piece}; "
        rows.append((i, text + word()))
    found = {r["doc_id"]: r for r in pii.listed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(set(spans) <= set(found[i]["spans"].split(",")) for i, spans in planted.items())
    assert all(r["n_added"] == len(planted.get(i, [])) for i, r in found.items())


def pii_luhn(number):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(number))) % 10


def test_redaction_rewrites_only_spans(spark):
    docs = spark.createDataFrame(
        [(1, "🙂 mail a@b.co now", 17, "s"), (2, "nothing", 7, "s"), (None, None, None, "s"), (3, "1.2.3.4 +1 (729) 555-7725", 25, "s")],
        "doc_id long, text string, n_chars long, source string",
    )
    rows = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert rows[1]["text"] == "🙂 mail [EMAIL] now" and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] == "nothing" and rows[None]["text"] is None
    assert rows[3]["text"] == "[IP] [PHONE]"


# ---- 10


def brute_simhash(text):
    words = text.encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, most):
    ids, low = list(prints), {}
    for i in ids:
        if i in low:
            continue
        queue, low[i] = [i], i
        while queue:
            at = queue.pop()
            for j in ids:
                if j not in low and (prints[at] ^ prints[j]).bit_count() <= most:
                    low[j] = i
                    queue.append(j)
    return low


def test_simhash_components(spark, edges, nothing):
    found = rows_of(spark, "op10_simhash")
    prints = {i: brute_simhash(t) for i, t in sorted(_texts(spark).items())}
    wanted = brute_components(prints, 3)
    for i, row in found.items():
        assert row["fingerprint"] == f"{prints[i]:016x}" and row["component_id"] == wanted[i]
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES) and {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {-5}
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(edges).where("doc_id = 7").count() == 1 and simhash.keep_one(edges).columns == edges.columns


@pytest.mark.parametrize("block", [4, 2048])
def test_dense_groups_keep_every_link(spark, block):
    rng = np.random.default_rng(block)
    centre = int(rng.integers(0, 1 << 62))
    prints = {}
    for i in range(150):
        value = centre
        for bit in rng.choice(64, size=rng.integers(0, 5), replace=False):
            value ^= 1 << int(bit)
        prints[i] = value
    marked = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "doc_id long, fp long")
    found = {r["fp"] & (1 << 64) - 1: r["component_id"] for r in simhash.classes(marked, 3, block).collect()}
    wanted = brute_components(prints, 3)
    assert all(found[v] == wanted[i] for i, v in prints.items())


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "src long, dst long")
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert roots == {**dict.fromkeys(range(1, 61), 0), 101: 100}
    assert components.components(links.limit(0)).count() == 0


def brute_near_copies(texts, least):
    """By id, the smallest id of those that links of likeness `least` or more bring together."""
    sets = {i: set(shingles(t, 5, lambda x: x.lower())[0]) or {tuple(shingles(t, 5)[1])} for i, t in texts.items()}
    low = {}
    for i in sorted(sets):
        if i in low:
            continue
        queue, low[i] = [i], i
        while queue:
            a = sets[queue.pop()]
            for j, b in sets.items():
                if j not in low and min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                    low[j] = i
                    queue.append(j)
    return low


@pytest.mark.parametrize("block", [3, 1024])
def test_near_copies_are_those_of_brute_force(spark, block):
    rng = np.random.default_rng(block)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(words, 40))
    texts = {}
    for group in range(30):
        base = list(rng.choice(words, int(rng.integers(12, 250))))
        for _ in range(int(rng.integers(1, 10)) if group else 60):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, max(2, len(copy) // 25)))):
                copy[at] = str(rng.choice(words))
            texts[len(texts)] = " ".join(copy) + (f" {line}" if group % 3 == 0 else "")
    texts |= {1000: "", 1001: " ", 1002: "one two", 1003: "ONE two", 1004: "one two three"}
    wanted = brute_near_copies(texts, 0.8)
    prints = {i: simhash.simhash(t, 5) & (1 << 64) - 1 for i, t in texts.items()}
    assert len(set(wanted.values())) < len(set(brute_components(prints, 3).values()))  # fingerprints alone miss some
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"] for r in near_copies.keep_one(docs, block=block).collect()}
    assert found == set(wanted.values())


def test_pipeline_joins_no_texts_below_the_likeness(spark, edges, nothing):
    larger = common.table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in larger.collect()}
    found = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, larger, "").collect()}
    assert found == set(brute_near_copies(texts, 0.8).values())
    kept = near_copies.keep_one(edges)
    assert kept.where("doc_id = 7").count() == 1 and kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.where("trim(coalesce(text, '')) IN ('', '\\n')").collect()) == [-5]
    assert near_copies.keep_one(nothing).count() == 0


# ---- the pipeline


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = common.table(spark, SF, "documents")
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.written(stage(spark, now, SF), name)
        assert sorted(now.columns) == sorted(docs.columns)
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    quality, near, clean, redacted = kept.values()
    assert set(redacted) == set(clean) <= set(near) <= set(quality) < set(_texts(spark))
    assert set(near) == set(brute_near_copies(quality, 0.8).values())
    items = {r["item_id"]: r["text"] for r in common.table(spark, SF, "benchmark").collect()}
    assert set(clean) == set(near) - {d for d, _ in brute_items(near, items)}
    for i, text in clean.items():
        wanted = text
        for kind, a, b in sorted(base_spans(text), key=lambda s: -s[1]):
            wanted = f"{wanted[:a]}[{kind.upper()}]{wanted[b:]}"
        assert redacted[i] == wanted
    last = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in redacted.items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(redacted)


def test_oracle_of_decontamination(spark):
    import duckdb

    from hearthbook.llm.oracles import OP6

    with duckdb.connect() as duck:
        for name in ("documents", "benchmark"):
            duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        wanted = sorted(duck.execute(f"SELECT doc_id, item_id, shared, item_shingles, containment FROM ({OP6})").fetchall())
    columns = ["doc_id", "item_id", "shared", "item_shingles", "containment"]
    assert sorted(map(tuple, QUERIES["op6_decontamination"](spark, SF).select(columns).collect())) == wanted


# ---- odd tables


def test_empty_benchmark_and_short_items_find_nothing(spark, edges):
    items = spark.createDataFrame([(1, "too few words"), (2, None), (3, "")], "item_id long, text string")
    for some in (items, items.limit(0)):
        found = decontamination.contaminated(edges, some)
        assert found.columns == ["doc_id", "item_id", "shared", "item_shingles", "containment"] and found.count() == 0
        assert decontamination.without_benchmark(edges, some).count() == edges.count()


def test_stages_take_tables_with_their_own_names(spark):
    """Columns that are named like those that the operators work with pass through."""
    text = "mail me at jane.doe@example.org now " + " ".join(f"w{i}" for i in range(30))
    names = ["found_id", "found_hash", "kept_id", "kept_hash", "own_hash", "span_id", "span_hash", "own_spans", "own_merged", "__spans", "root", "set_id"]
    docs = spark.createDataFrame([(1, text, *names), (2, text, *names), (3, "other", *names)], ["doc_id", "text", *names])
    items = spark.createDataFrame([(1, "nothing of the kind is said here")], "item_id long, text string")
    clean = decontamination.without_benchmark(docs, items)
    assert clean.columns == docs.columns and clean.count() == 3
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    redacted = pii.redacted(docs)
    assert redacted.columns == docs.columns
    assert all("[EMAIL]" in r["text"] and r["found_id"] == "found_id" for r in redacted.where("doc_id < 3").collect())


def test_neighbours_tie_to_the_earlier_row():
    rng = np.random.default_rng(0)
    known = rng.integers(0, 2, (40, 6)).astype(float)
    known /= np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)
    labels = rng.integers(0, 2, 40).astype(float)
    for _ in range(50):
        latent = known[rng.permutation(40)[:7]]
        found = quality_knn.votes(latent, known, labels, 5)
        for row, score in zip(latent, found, strict=True):
            near = [round(float(row @ k) * 1e9) for k in known]
            best = sorted(sorted(range(40), key=lambda j: (-near[j], j))[:5])
            weights = [max(near[j], 0) / 1e9 for j in best]
            total = sum(w**8 for w in weights)
            wanted = sum(w**8 * labels[j] for w, j in zip(weights, best, strict=True)) / total if total else labels.mean()
            assert abs(score - wanted) < 1e-12


def test_quality_scores_are_those_of_plain_loops(spark):
    """Features, weights, cosines and votes by loops over sf0.001; the directions are those that the fit found."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = quality_knn.fit(docs, labels)
    texts = _texts(spark)
    features = {i: quality_knn.counts(t) for i, t in texts.items()}
    seen = sum((f > 0).astype(int) for f in features.values())
    idf = np.log((1.0 + len(texts)) / (1.0 + seen)).astype(np.float32) + np.float32(0.1)
    assert np.array_equal(idf, model.idf)
    assert np.abs(model.directions.T @ model.directions - np.eye(model.directions.shape[1])).max() < 1e-4
    marked = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    learned = sorted(i for i in marked if zlib.crc32(str(i).encode()) % 5 and i in texts)
    assert model.labels.tolist() == [marked[i] for i in learned]

    def latent(i):
        row = np.array([math.log1p(x) for x in features[i]]) * idf
        row = row / max(np.linalg.norm(row), 1e-12) @ model.directions
        return row / max(np.linalg.norm(row), 1e-12)

    known = [latent(i) for i in learned]
    for i, row in rows_of(spark, "op5_quality_knn").items():
        mine = latent(i)
        near = [round(float(mine @ k) * 1e9) for k in known]
        best = sorted(range(len(known)), key=lambda j: (-near[j], j))[: quality_knn.NEIGHBOURS]
        weights = {j: (max(near[j], 0) / 1e9) ** quality_knn.POWER for j in best}
        total = sum(weights.values())
        wanted = sum(w * marked[learned[j]] for j, w in weights.items()) / total if total else np.mean(model.labels)
        assert abs(row["score"] - wanted) < 1e-6


def test_equal_texts_have_equal_quality(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = docs.select("doc_id", "text").join(quality_knn.quality_scores(docs, labels).select("doc_id", "score"), "doc_id").collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert len(by_text) < len(rows) and all(len(s) == 1 for s in by_text.values())
