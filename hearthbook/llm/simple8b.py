"""Token ids in files, packed by Simple-8b into 64-bit words.

A word's top four bits, the selector, say how many ids its other 60 bits hold and how wide
they are: 60 of one bit up to one of 60. Wider ids escape: their word holds the escape
selector only, and the id stands in a section of its own, so that words can be decoded all
at once whatever their payload looks like. Within a segment, the words of each block of
BLOCK ids begin anew and their offsets are stored, so a block can be read by itself.

A segment is one binary value, little-endian:

    8 bytes   magic HBS8B001
    6 x u32   documents, blocks, ids per block, words, escapes, 0
    i64[]     doc_id of each document (a null id: the smallest number)
    u32[]     number of ids of each document
    u32[]     first word of each block
    u32[]     first escape of each block
    u64[]     words
    u64[]     escapes

The files are Parquet with a segment per row, (shard, segment, ids, payload), uncompressed:
any store that Spark writes will do, and a task that is run again leaves no half file. A
shard holds a range of documents; shards, segments and documents are in ascending order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hearthbook.llm.byte_bpe import units
from hearthbook.llm.common import new_path, remembered, text_of, texts
from hearthbook.llm.ordered import shuffle_width

MAGIC = b"HBS8B001"
BLOCK = 4096
#: A segment is closed at this many ids; a longer document has a segment to itself.
SEGMENT_IDS = 262_144
END_ID = 0
NULL_ID = -(1 << 63)
MEMO = 700_000
# Fixed value: where a byte-level tokenizer that cuts at words does so.
_CUTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BLANK = chr(256 + 32)  # the letter that stands for a blank
_BLANK_AND_MORE = re.compile(r" \s")

# Ids per word and their width in bits, by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0


def _fits(small: np.ndarray, count: int) -> np.ndarray:
    """By place of each row, whether it and the count - 1 after it are small; beyond the end all are."""
    out, have = small, 1
    while have < count:
        step = min(have, count - have)
        shifted = np.ones(out.shape, bool)
        shifted[:, :-step] = out[:, step:]
        out = out & shifted
        have += step
    return out


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes, first escape of each block) of uint64 ids.

    From the left of each block, as many ids to a word as will go.
    """
    n = len(values)
    blocks = -(-n // block)
    rows = np.zeros((blocks, block), np.uint64)
    rows.reshape(-1)[:n] = values
    selector = np.full((blocks, block), ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, 0, -1):  # later ones hold more
        fits = _fits(rows < np.uint64(1 << int(WIDTHS[s])), int(COUNTS[s]))
        if not fits.any():
            break
        selector[fits] = s
    # The words of all blocks are cut at once, each time the next one of every block.
    ahead = COUNTS[selector].reshape(-1)
    at = np.arange(blocks) * block
    ends = np.minimum(at + block, n)
    rounds = []
    while len(at):
        rounds.append(at)
        at = at + ahead[at]
        open_ones = at < ends
        at, ends = at[open_ones], ends[open_ones]
    first = np.sort(np.concatenate(rounds)) if rounds else np.empty(0, np.int64)
    word_starts = np.searchsorted(first, np.arange(blocks) * block)
    chosen = selector.reshape(-1)[first] if n else np.empty(0, np.int8)
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat = rows.reshape(-1)
    for s in np.unique(chosen).tolist():
        if s == ESCAPE:
            continue
        mine = np.flatnonzero(chosen == s)
        begins = first[mine]
        room = np.minimum(block - begins % block, int(COUNTS[s]))  # not into the next block
        made = words[mine]
        for k in range(int(COUNTS[s])):
            there = k < room
            part = flat[np.minimum(begins + k, len(flat) - 1)] << np.uint64(k * int(WIDTHS[s]))
            made |= part if there.all() else np.where(there, part, np.uint64(0))
        words[mine] = made
    escaped = first[chosen == ESCAPE]
    escape_starts = np.searchsorted(escaped, np.arange(blocks) * block)
    return words, word_starts, values[escaped], escape_starts


def unpack(words: np.ndarray, escapes: np.ndarray, word_starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of blocks of `counts` ids, whose words begin at word_starts; all at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selector]
    ends = np.append(word_starts, len(words))
    total = np.add.reduceat(held, word_starts) if len(word_starts) else held
    # The last word of a block may be padded; what it holds too much is taken off.
    held[ends[1:] - 1] -= total - counts
    at = np.cumsum(held) - held
    out = np.empty(int(counts.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[at[mine]] = escapes
            continue
        width = int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        for k in range(int(COUNTS[s])):
            whole = mine[held[mine] > k]
            out[at[whole] + k] = (words[whole] >> np.uint64(k * width)) & mask
    return out


def write_segment(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate([np.asarray(x, np.uint64) for x in ids]) if ids else np.empty(0, np.uint64)
    words, word_starts, escapes, escape_starts = pack(flat)
    header = struct.pack("<6I", len(doc_ids), len(word_starts), BLOCK, len(words), len(escapes), 0)
    return b"".join([
        MAGIC, header, np.array(doc_ids, "<i8").tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(),
        word_starts.astype("<u4").tobytes(), escape_starts.astype("<u4").tobytes(),
        words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
    ])


def read_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids) of a segment."""
    if payload[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, blocks, block, n_words, n_escapes, _ = struct.unpack_from("<6I", payload, 8)
    at = 32

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, sizes = take("<i8", docs), take("<u4", docs)
    word_starts, _ = take("<u4", blocks), take("<u4", blocks)
    words, escapes = take("<u8", n_words), take("<u8", n_escapes)
    counts = np.full(blocks, block, np.int64)
    if blocks:
        counts[-1] = int(sizes.sum(dtype=np.int64)) - block * (blocks - 1)
    return doc_ids, sizes, unpack(words, escapes, word_starts.astype(np.int64), counts)


def read_block(payload: bytes, number: int) -> np.ndarray:
    """The ids of one block, read by its offsets alone."""
    docs, blocks, block, n_words, n_escapes, _ = struct.unpack_from("<6I", payload, 8)
    at = 32 + 8 * docs
    sizes = np.frombuffer(payload, "<u4", docs, at)
    starts = np.frombuffer(payload, "<u4", 2 * blocks, at + 4 * docs).astype(np.int64)
    base = at + 4 * docs + 8 * blocks
    ends = [starts[number + 1] if number + 1 < blocks else n_words, starts[blocks + number + 1] if number + 1 < blocks else n_escapes]
    words = np.frombuffer(payload, "<u8", ends[0] - starts[number], base + 8 * starts[number])
    first = starts[blocks + number]
    escapes = np.frombuffer(payload, "<u8", ends[1] - first, base + 8 * n_words + 8 * first)
    last = int(sizes.sum(dtype=np.int64)) - block * (blocks - 1)
    return unpack(words, escapes, np.array([0]), np.array([block if number + 1 < blocks else last]))


# ---- documents to files and back


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(others)}}


def _splits_at_words(definition: dict) -> bool:
    """Whether a tokenizers file says: bytes, cut at words and blanks, merged by one vocabulary, nothing else."""
    cutter = definition.get("pre_tokenizer") or {}
    return (
        definition.get("normalizer") is None
        and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        and (definition.get("model") or {}).get("type") == "BPE"
    )


class _Tokenizer:
    """The tokenizers library over units of text; what a unit gives is remembered.

    A byte-level tokenizer that cuts at words (as its definition must say) cuts a text before each blank that something else than
    white space follows. So the ids of a text are those of its units; a unit is cut into pieces by the
    same rule, and these go to the vocabulary's merges at once. Texts that name an added token, and all texts under another definition, go
    to the library as they are.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.model = self.library.model
        said = json.loads(definition)
        self.added = [t["content"] for t in said.get("added_tokens") or []]
        self.by_units = _splits_at_words(said)
        self.letters = _byte_letters()
        self.known = _Units(self)
        self.end = array("I", [END_ID]).tobytes()

    def merged(self, letters: str) -> bytes:
        """The ids of a piece, given by the letters that stand for its bytes."""
        return array("I", [p.id for p in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self.merged(piece.encode().decode("latin-1").translate(self.letters))

    def unit(self, unit: str) -> bytes:
        if unit[unit[0] == " " :].isalpha():
            return self._piece(unit)
        pieces = _CUTS.findall(unit)
        find = self.known.__getitem__
        return b"".join([find(p[1:]) if p[0] == " " and len(p) > 1 and pieces != [unit] else self._piece(p) for p in pieces])

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        find = self.known.__getitem__
        if text[:1] == " " or text[-1:] == " " or _BLANK_AND_MORE.search(text):  # not just a blank between words
            return b"".join([find(u[1:]) if u[0] == " " and len(u) > 1 else self.unit(u) for u in units(text)])
        first, *rest = text.split(" ")
        return b"".join([self.unit(first) if first else b"", *map(find, rest)])

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        self.known.forget()
        out = []
        for text in batch:
            by_units = self.by_units and not any(a in text for a in self.added)
            out.append(np.frombuffer((self.ids(text) if by_units else self.whole(text)) + self.end, np.uint32))
        return out


class _Units(dict):
    """Ids of a blank and what follows it, by what follows. What isn't used again before the next time is forgotten."""

    def __init__(self, tokenizer: _Tokenizer):
        self.tokenizer, self.older = tokenizer, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            if part.isascii() and part.isalpha():  # one piece, whose letters stand for themselves
                found = self.tokenizer.merged(_BLANK + part)
            else:
                found = self.tokenizer.unit(" " + part)
        self[part] = found
        return found

    def forget(self) -> None:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()


def _tokenizer(shared) -> _Tokenizer:
    name, definition = shared.value
    return remembered(("simple8b", name), lambda: _Tokenizer(definition))


def write_ids(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encodes every whole text (null: empty) and writes the ids, END_ID after each document.

    Documents are in ascending doc_id order (null first, equal ids by a hash of the text): shard by shard,
    and within a shard by segment. A shard is a range of rows, of equal ones too, so no id makes a large one. tokenizer is a tokenizers file, read by the driver; its
    size doesn't depend on the data.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast((tokenizer, file.read()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # The last key deals out repeated rows, too: they are alike, so their order doesn't matter.
    keys = ["doc_id", "text_hash", "turn"]
    ordered = rows.withColumns({"text_hash": F.xxhash64("text"), "turn": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(shuffle_width(docs), *keys).sortWithinPartitions(*keys)
    wanted = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, doc_ids, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([held], pa.int64()),
                 pa.array([write_segment(doc_ids, ids)], pa.binary())],
                schema=wanted,
            )

        for batch in batches:
            known = _tokenizer(shared)
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                encoded = known.encode(texts(some))
                for doc_id, found in zip(some.column("doc_id").to_pylist(), encoded, strict=True):
                    if doc_ids and held + len(found) > SEGMENT_IDS:
                        yield close()
                        segment += 1
                        doc_ids, ids, held = [], [], 0
                    doc_ids.append(NULL_ID if doc_id is None else doc_id)
                    ids.append(found)
                    held += len(found)
        if doc_ids:
            yield close()

    made = ordered.select("doc_id", "text").mapInArrow(run, "shard int, segment int, ids long, payload binary")
    made.write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files, and its ids if asked for.

    start counts the ids of all documents before it: sizes of segments are summed per shard,
    and sizes of shards over shards, so no task orders all segments.
    """
    files = spark.read.schema("shard int, segment int, ids long, payload binary").parquet(path)
    sizes = files.select("shard", "segment", "ids")
    shards = sizes.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shards
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(shards, "shard").select(
        "shard", "segment", (F.col("shard_start") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("first")
    )
    kinds = [("shard", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds += [("ids", pa.list_(pa.int64()))] if with_ids else []
    wanted = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, payload in zip(*(batch.column(c) for c in ("shard", "segment", "payload")), strict=True):
                doc_ids, counts, ids = read_segment(payload.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                narrow = ids.astype("<u4")
                crcs = [zlib.crc32(narrow[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                columns = [
                    pa.array([shard.as_py()] * n, pa.int32()), pa.array([segment.as_py()] * n, pa.int32()),
                    pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID), pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    schema = "shard int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else "")
    return files.mapInArrow(run, schema).join(starts, ["shard", "segment"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stored_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of docs to new files in the shared folder and reads them back."""
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path)
