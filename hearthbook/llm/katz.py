"""Language-model scores by a Katz back-off bigram model over all training documents.

Tokens are words (A-Z in lower case) and one end per document. With c the training counts:

    P(v | u) = d(c(u v)) * c(u v) / c(u)     if u v was seen
             = alpha(u) * P(v)               else; alpha is 1 for a context never seen
    P(v)     = d'(c(v)) * c(v) / N           if v was seen
             = what these leave of 1         for all other words together

d is the Good-Turing discount for counts up to K, from the counts of counts of all n-grams of
its order; larger counts keep all but TAIL, so every context leaves some mass. alpha(u) is the
mass that the seen successors of u leave, over the part of P that they don't cover, so each
context's distribution sums to 1 exactly.

How it runs. Words are counted first, and with them the pairs of DENSE frequent words, as a
matrix of bounded size; positions with such a pair are later scored where they are read. The
HOT most frequent words are broadcast with their counts (a bounded table); others go by a
64-bit hash. All other positions are shuffled once, one row per document and
pair: by the pair where the second word is hot, by that word where it is not. A task then has
all rows of a pair, so it counts the pair, and scores its rows, in one go; no pair beyond DENSE
is frequent enough to fill a task, and one document adds one row at most. What it finds out
is stored in tables partitioned by kind: sums per document, sums per context, and the positions
that back off. The last join, of the third with the second, gives these their alpha.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hearthbook.llm.common import new_path, text_of, texts, written

FOLDS, HELD_OUT = 7, 2
K = 5
TAIL = 1e-6
HOT = 65_536
DENSE = 1_024
#: Rows that a task works on at once, and positions between two sums per document.
AT_ONCE, SUMMED = 100_000, 400_000
#: Documents or contexts whose sums a task keeps before it passes them on, and rows in one batch.
FLUSH, BATCH = 500_000, 50_000
SORTED = 250_000
#: Share of the documents that the dense words are looked for in.
DENSE_SAMPLE = 0.02
MEMO = 300_000

# Ids: hot words by rank from 1, the end 0, the start -1, any other word its hash.
END, START = 0, -1
_FIELDS = ("s", "base", "known", *(f"m{r}" for r in range(1, K + 1)), "tokens", "doc")
# A pair of hot ids u, v is one id: (v + 1) * _PAIR + u + 1; it and the hot ids are below _PAIRS.
_PAIR, _PAIRS = 1 << 17, 1 << 35
_MOST = 255  # times in one row
_MARK = -(1 << 63)  # ids from here on mark rows that carry a field of a document


def tokens(text: str) -> list[bytes]:
    """The words of a text, without the end."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def log_count(c: np.ndarray) -> np.ndarray:
    """log10 of d(c) * c without the Good-Turing part, which is only known at the end; 0 for 0."""
    return np.log10(np.maximum(c, 1)) + np.where(c > K, math.log10(1 - TAIL), 0.0)


def discounts(counts_of_counts: dict[int, int], k: int = K) -> list[float]:
    """d(0..k), Good-Turing; d(r) is (r - 1/2) / r where the counts of counts give none in (0, 1)."""
    n = counts_of_counts
    out = [1.0]
    rest = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        d = None
        if n.get(r) and n.get(r + 1) and rest < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
        out.append(d if d is not None and 0 < d < 1 else (r - 0.5) / r)
    return out


class Unigrams:
    """What is known of single words: totals, the discounts, and the hot words.

    dense: the words with the first ids, of any frequency; hot: ids of further words, with counts.
    """

    def __init__(self, total: int, types: int, documents: int, counts_of_counts: dict[int, int],
                 dense: list[bytes], dense_counts: list[int], hot: list[tuple[int, int]]):
        self.total, self.types, self.documents = total, types, documents
        self.d = discounts(counts_of_counts)
        self.dense = {word: i + 1 for i, word in enumerate(dense)}
        self.ranks = {x: i + 1 + len(dense) for i, (x, _) in enumerate(hot)}
        self.counts = np.array([documents, *dense_counts, *(n for _, n in hot)], np.int64)
        small = sum(r * n for r, n in counts_of_counts.items() if r <= K)
        kept = sum(self.d[r] * r * n for r, n in counts_of_counts.items() if r <= K)
        self.unknown = 1.0 - (kept + (1 - TAIL) * (total - small)) / total if total else 1.0

    def chance(self, count: np.ndarray) -> np.ndarray:
        """P of a word by its count."""
        d = np.array([0.0, *self.d[1:], 1 - TAIL])[np.minimum(count, K + 1)]
        return np.where(count > 0, d * count / max(self.total, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-one chance."""
        return np.log10((count + 1) / (self.total + self.types + 1))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def common_words(rows: DataFrame, count: int) -> list[bytes]:
    """The words that get the dense ids, the most frequent ones of a sample.

    Which words these are decides where a pair is counted, never what comes out.
    """
    wanted = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(w for text in texts(batch) for w in tokens(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=wanted)

    made = rows.select("text").sample(DENSE_SAMPLE, seed=7).mapInArrow(run, "word binary, n long")
    top = made.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(count)
    return [bytes(r["word"]) for r in top.collect()]


class Reader:
    """Turns texts into ids; what a word's id is, is remembered."""

    def __init__(self, dense: dict[bytes, int], ranks: dict[int, int]):
        self.dense, self.ranks = dense, ranks
        self.memo = dict(dense)
        self.size = len(self.memo) + MEMO

    def ids(self, text: str) -> np.ndarray:
        known = self.memo
        found = tokens(text)
        out = list(map(known.get, found))
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    word = found[i]
                    x = known.get(word)
                    if x is None:
                        x = _hash(word)
                        x = self.ranks.get(x, x)
                        if len(known) >= self.size:
                            known.clear()
                            known.update(self.dense)
                        known[word] = x
                    out[i] = x
        out.append(END)
        return np.array(out, np.int64)


def _hash(word: bytes) -> int:
    """A word's hash, signed, kept clear of all other ids."""
    x = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(word)))[0]
    return x ^ (1 << 61) if -2 <= x <= 1 << 40 or x < _MARK + 64 else x


def count_words(rows: DataFrame, hot: int = HOT, dense: int = DENSE) -> tuple[Unigrams, np.ndarray]:
    """Counts over all training documents: of words, and of pairs of dense ids.

    The second is a matrix of dense + 1 rows (by the word before; the start is the last one).
    All counts are summed within each batch before the shuffle.
    """
    first = common_words(rows, dense - 1)
    size = len(first) + 1
    shared = rows.sparkSession.sparkContext.broadcast({word: i + 1 for i, word in enumerate(first)})
    wanted = pa.schema([("pair", pa.bool_()), ("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, {})
        pairs = np.zeros((size + 1) * size, np.int64)
        for batch in batches:
            every = [np.empty(0, np.int64)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                if not is_held_out(doc_id):
                    v = reader.ids(text)
                    every.append(v)
                    u = np.concatenate([[size], v[:-1]])
                    both = (v >= 0) & (v < size) & (u >= 0) & ((u < size) | (np.arange(len(v)) == 0))
                    pair, n = np.unique(u[both] * size + v[both], return_counts=True)
                    pairs[pair] += n
            ids, n = np.unique(np.concatenate(every), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), bool)), pa.array(ids), pa.array(n)], schema=wanted)
        found = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), bool)), pa.array(found), pa.array(pairs[found])], schema=wanted)

    made = rows.select("doc_id", "text").mapInArrow(run, "pair boolean, id long, n long")
    counts = written(made.groupBy("pair", "id").agg(F.sum("n").alias("n")), "katz-unigrams")
    matrix = np.zeros((size + 1) * size, np.int64)
    found = counts.where("pair").select("id", "n").toArrow()  # (dense + 1) * dense rows at most
    matrix[found["id"].to_numpy()] = found["n"].to_numpy()
    words = counts.where("NOT pair").select("id", "n")
    total = words.agg(F.sum("n"), F.count("*"), *[F.count(F.when(F.col("n") == r, 1)) for r in range(1, K + 2)]).first()
    some = dict(words.where(F.col("id").between(0, size - 1)).toArrow().select(["id", "n"]).to_pandas().itertuples(index=False))
    top = words.where(~F.col("id").between(0, size - 1)).orderBy(F.desc("n"), "id").limit(hot).collect()
    known = Unigrams(
        total[0] or 0, total[1], some.get(END, 0), {r: total[1 + r] for r in range(1, K + 2)},
        first, [some.get(i + 1, 0) for i in range(len(first))], [(r["id"], r["n"]) for r in top],
    )
    return known, matrix.reshape(size + 1, size)


def positions(rows: DataFrame, shared) -> DataFrame:
    """(v, u, row): what can't be settled where it is read, and what is settled there.

    Two hot ids are put together as v, with u 0. row tells documents apart (twice a row id, and
    1 more if held out), and how often the pair occurs: row * (_MOST + 1) + times. Rows with an id from _MARK on
    carry one sum over the document's settled positions each, in u.
    """
    wanted = pa.schema([(c, pa.int64()) for c in ("v", "u", "row")])

    def sorted_rows(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        v, u, row = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
        order = np.argsort(v, kind="stable")
        v, u, row = v[order], u[order], row[order]
        first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (row[1:] != row[:-1])]) if len(v) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(v)))
        marks = v[first] < _MARK + len(_FIELDS)
        n[marks] = 0
        copies = np.where(marks, 1, (n + _MOST - 1) // _MOST)
        at = np.repeat(first, copies)
        last = np.cumsum(copies) - 1
        times = np.full(len(at), _MOST)
        times[last] = n - (copies - 1) * _MOST
        return pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(u[at]), pa.array(row[at] * (_MOST + 1) + times)], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrix = shared.value
        reader = Reader(words.dense, words.ranks)
        dense, hot_ids = matrix.shape[1], len(words.counts)
        hot_base = words.base(words.counts)
        hot_log = np.log10(np.maximum(words.counts, 1))
        start_log = math.log10(words.documents) if words.documents else 0.0
        parts: list[list[np.ndarray]] = [[], [], []]
        held = 0
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                row = 2 * row + is_held_out(doc_id)
                v = reader.ids(text)
                u = np.concatenate([[START], v[:-1]])
                hot = v[(v >= 0) & (v < hot_ids)]
                known = hot[words.counts[hot] > 0]
                context = hot[hot != END]
                in_matrix = (v >= 0) & (v < dense) & (u >= START) & (u < dense)
                seen = np.zeros(len(v), np.int64)
                at = np.where(u == START, dense, u)
                seen[in_matrix] = matrix[at[in_matrix], v[in_matrix]]
                done = seen > 0
                c = seen[done]
                sums = np.array([log_count(c).sum() - hot_log[context].sum() - start_log, hot_base[hot].sum()])
                whole = [len(known), *np.bincount(c[c <= K], minlength=K + 1)[1:].tolist(), len(v)]
                fields = [*sums.view(np.int64).tolist(), *whole, *([] if doc_id is None else [doc_id])]
                kept = [i for i, x in enumerate(fields) if x or i == len(_FIELDS) - 1]
                v, u = v[~done], u[~done]
                both = (v >= 0) & (v < hot_ids) & (u >= START) & (u < hot_ids)
                parts[0] += [np.array(kept) + _MARK, np.where(both, (v + 1) * _PAIR + u + 1, v)]
                parts[1] += [np.array([fields[i] for i in kept]), np.where(both, 0, u)]
                parts[2].append(np.full(len(kept) + len(v), row))
                held += len(kept) + len(v)
                if held >= SORTED:
                    yield sorted_rows(parts)
                    parts, held = [[], [], []], 0
        yield sorted_rows(parts)

    return rows.select("row", "doc_id", "text").mapInArrow(run, "v long, u long, row long")


_OUT = "kind int, key long, x double, y double, c0 long, " + ", ".join(f"c{r} int" for r in range(1, K + 2)) + ", doc long, tokens long"


class _Task:
    """Counts and scores the sorted positions of one partition."""

    def __init__(self, words: Unigrams):
        self.words = words
        self.schema = pa.schema([
            ("kind", pa.int32()), ("key", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("c0", pa.int64()),
            *((f"c{r}", pa.int32()) for r in range(1, K + 2)), ("doc", pa.int64()), ("tokens", pa.int64()),
        ])
        self.parts: list[list[np.ndarray]] = []
        self.contexts: list[np.ndarray] = []
        self.held = 0
        # Sums so far, by the document's row and by the context: the id, sums, counts.
        self.by_row = np.empty(0, np.int64), np.empty((2, 0)), np.empty((1 + K, 0), np.int64)
        self.by_context = np.empty(0, np.int64), np.empty((1, 0)), np.empty((2 + K, 0), np.int64)

    def out(self, kind: int, n: int, **columns) -> pa.RecordBatch:
        columns["kind"] = np.full(n, kind, np.int32)
        arrays = [
            (columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name])).cast(f.type) if f.name in columns else pa.array(np.zeros(n), f.type) if f.name not in ("doc", "tokens") else pa.nulls(n, f.type)
            for f in self.schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def outs(self, kind: int, n: int, **columns) -> Iterator[pa.RecordBatch]:
        for i in range(0, n, BATCH):
            yield self.out(kind, min(BATCH, n - i), **{name: column[i : i + BATCH] for name, column in columns.items()})

    def work(self, v: np.ndarray, u: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        """v, u, row: whole groups, in order of v, as positions() packs them."""
        order = np.lexsort((u, v))
        v, u, row = v[order], u[order], row[order]
        n = row % (_MOST + 1)
        row = row // (_MOST + 1)
        words = self.words
        marks = int(np.searchsorted(v, _MARK + len(_FIELDS)))
        if marks:
            yield self.fields(v[:marks] - _MARK, u[:marks], row[:marks])
            v, u, row, n = v[marks:], u[marks:], row[marks:], n[marks:]
        if not len(v):
            return
        both = (v >= _PAIR) & (v < _PAIRS)
        v, u = np.where(both, v // _PAIR - 1, v), np.where(both, v % _PAIR - 1, u)
        trained = np.where(row & 1, 0, n)
        new_word = np.r_[True, v[1:] != v[:-1]]
        new_pair = new_word | np.r_[True, u[1:] != u[:-1]]
        pair, word = np.cumsum(new_pair) - 1, np.cumsum(new_word) - 1
        c_pair = np.bincount(pair, trained).astype(np.int64)
        hot = (v >= 0) & (v < len(words.counts))
        c_word = np.where(hot, words.counts[np.where(hot, v, 0)], np.bincount(word, trained).astype(np.int64)[word])
        c = c_pair[pair]
        seen = c > 0
        cold = ~hot
        p = words.chance(c_word)
        s = n * np.where(seen, log_count(c), np.log10(p))
        s -= np.where(cold & (c_word > 0), n * np.log10(np.maximum(c_word, 1)), 0.0)
        # Per position: its times, its count up to K, and whether it is a known cold word.
        marks = np.stack([n, np.where(c <= K, c, 0), cold & (c_word > 0)]).astype(np.int32)
        self.parts.append([row, np.stack([s, np.where(cold, n * words.base(c_word), 0.0)]), marks])
        first = np.flatnonzero(new_pair)
        first = first[c[first] > 0]
        self.contexts.append(np.stack([u[first], c[first], p[first].view(np.int64)]))
        if not seen.all():
            rest = ~seen
            yield from self.outs(2, int(rest.sum()), key=u[rest], doc=row[rest], c0=n[rest])
        self.held += len(v)
        if self.held >= SUMMED:
            self.sum_up()
            if max(len(self.by_row[0]), len(self.by_context[0])) >= FLUSH:
                yield from self.flush()

    def fields(self, field: np.ndarray, value: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        """One row of sums for each document of which fields have come."""
        rows, of = np.unique(row, return_inverse=True)
        columns: dict = {"key": rows}
        for i, name in enumerate(_FIELDS):
            mine = field == i
            column = {"s": "x", "base": "y", "known": "c0"}.get(name, f"c{name[1:]}" if name[0] == "m" else name)
            made = np.zeros(len(rows), np.float64 if name in ("s", "base") else np.int64)
            made[of[mine]] = value[mine].copy().view(made.dtype)
            if name in ("doc", "tokens"):
                there = np.zeros(len(rows), bool)
                there[of[mine]] = True
                made = pa.array(made, mask=~there)
            columns[column] = made
        return self.out(0, len(rows), **columns)

    def sum_up(self) -> None:
        """Adds the positions held to the sums per document and per context, so that none of them is kept."""
        if self.parts:
            row, sums, marks = (np.concatenate(x, axis=-1) for x in zip(*self.parts, strict=True))
            self.parts = []
            n, c, known = marks
            self.by_row = _added(self.by_row, row, sums, lambda: [n * known, *(np.where(c == r, n, 0) for r in range(1, K + 1))])
            context, count, chance = np.concatenate(self.contexts, axis=1)
            self.contexts = []
            self.by_context = _added(
                self.by_context, context, chance.view(np.float64)[None], lambda: [count, *(count == r for r in range(1, K + 2))]
            )
        self.held = 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.sum_up()
        row, sums, counts = self.by_row
        yield from self.outs(0, len(row), key=row, x=sums[0], y=sums[1], c0=counts[0], **{f"c{r}": counts[r] for r in range(1, K + 1)})
        context, sums, counts = self.by_context
        yield from self.outs(1, len(context), key=context, x=sums[0], c0=counts[0], **{f"c{r}": counts[r] for r in range(1, K + 2)})
        self.by_row, self.by_context = (tuple(x[..., :0] for x in kept) for kept in (self.by_row, self.by_context))


def _added(kept: tuple, key: np.ndarray, sums: np.ndarray, counts: Callable[[], list[np.ndarray]]) -> tuple:
    """kept (keys, sums, counts) with further rows added, one column at a time."""
    keys, of = np.unique(np.concatenate([kept[0], key]), return_inverse=True)
    old, new = of[: len(kept[0])], of[len(kept[0]) :]

    def total(column: np.ndarray, before: np.ndarray, made: np.ndarray) -> None:
        made[:] = np.bincount(new, column, len(keys))
        made[old] += before

    x, c = np.empty((len(kept[1]), len(keys))), np.empty((len(kept[2]), len(keys)), np.int64)
    for column, before, made in zip(sums, kept[1], x, strict=True):
        total(column, before, made)
    for column, before, made in zip(counts(), kept[2], c, strict=True):
        total(column, before, made)
    return keys, x, c


def settled(found: DataFrame, shared) -> DataFrame:
    """Sums per document (kind 0) and per context (1), and positions that back off (2)."""
    key = (
        F.when(F.col("v") < _MARK + len(_FIELDS), F.col("row"))
        .when((F.col("v") >= 0) & (F.col("v") < _PAIRS), F.xxhash64("u", "v")).otherwise(F.col("v"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(shared.value[0])
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("v", "u", "row")])
            size += batch.num_rows
            if size < AT_ONCE or not batch.num_rows:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            v = rows[0]
            end = np.flatnonzero(v != v[-1])
            cut = int(end[-1]) + 1 if len(end) else 0
            if cut:
                yield from task.work(*(x[:cut] for x in rows))
            held = [[x[cut:] for x in rows]]
            size = len(v) - cut
        if held:
            yield from task.work(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield from task.flush()

    return found.repartition(key).sortWithinPartitions("v").mapInArrow(run, _OUT)


def dense_contexts(words: Unigrams, matrix: np.ndarray) -> list[tuple]:
    """The sums per context of the pairs in the matrix: at most as many rows as it has."""
    out = []
    p = words.chance(words.counts[: matrix.shape[1]])
    for i, counts in enumerate(matrix):
        if counts.any():
            seen = counts[: len(p)]
            out.append((START if i == matrix.shape[1] else i, float(p[seen > 0].sum()), int(seen.sum()), *(int((seen == r).sum()) for r in range(1, K + 2))))
    return out


def scores(docs: DataFrame, hot: int = HOT, dense: int = DENSE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Training documents are those whose crc32(doc_id as text) modulo FOLDS isn't HELD_OUT; a
    null id trains. Null and empty texts are one end. Without any training document every
    word is unknown and has chance 1. hot and dense change what is broadcast, not results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    words, matrix = count_words(rows, hot, dense)
    shared = spark.sparkContext.broadcast((words, matrix))
    path = new_path(spark, "katz-sums")
    settled(positions(rows, shared), shared).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(_OUT).parquet(path)

    counts = [F.sum(f"c{r}").alias(f"c{r}") for r in range(1, K + 2)]
    names = ["key", "x", "c0", *(f"c{r}" for r in range(1, K + 2))]
    some = spark.createDataFrame(dense_contexts(words, matrix), ", ".join(f"{n} {'double' if n == 'x' else 'long'}" for n in names))
    contexts = stored.where("kind = 1").select(*names).union(some).groupBy("key").agg(F.sum("x").alias("x"), F.sum("c0").alias("c0"), *counts)
    totals = stored.where("kind = 1").select(*names).union(some).agg(*counts).first()
    d = discounts({r: totals[r - 1] or 0 for r in range(1, K + 2)})
    small = sum(F.col(f"c{r}") * r for r in range(1, K + 1))
    kept = sum(F.col(f"c{r}") * (r * d[r]) for r in range(1, K + 1)) + (F.col("c0") - small) * (1 - TAIL)
    alpha = (1 - kept / F.col("c0")) / (1 - F.col("x"))
    contexts = contexts.select("key", (F.log10("c0") + F.log10(alpha)).alias("weight"))
    backed = (
        stored.where("kind = 2").select("key", F.col("doc").alias("row"), F.col("c0").alias("n"))
        .join(contexts, "key")
        .select("row", (F.col("n") * F.col("weight")).alias("s"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"),
                F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("tokens"))
    )
    seen = F.col("x") + sum(F.col(f"c{r}") * math.log10(d[r]) for r in range(1, K + 1))
    direct = stored.where("kind = 0").select(
        F.col("key").alias("row"), seen.alias("s"), F.col("y").alias("base"), F.col("c0").alias("known"), "doc", "tokens"
    )
    return (
        direct.union(backed).groupBy("row")
        .agg(F.max("doc").alias("doc_id"), F.sum("s").alias("score"), F.sum("base").alias("base_score"), F.sum("known").alias("n_known"),
             F.sum("tokens").alias("n_tokens"))
        .select("doc_id", (F.col("row") % 2 == 1).alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"),
                "base_score", "score")
    )
