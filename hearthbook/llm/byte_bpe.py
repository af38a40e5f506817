"""Byte-level BPE: encoding by backtracking over an Aho-Corasick automaton, and decoding.

Each piece that the pattern cuts out is encoded by itself. Its bytes are mapped to Latin-1
characters, so that pyahocorasick, which works on text, sees one character per byte. From
the left, the longest vocabulary entry is taken; it stands if it is compatible with the
token before it, else the next shorter entry is tried, and where none is left the last
token is taken back. A position that failed once is never tried again, so the work is
linear in the length of the piece. Two tokens are compatible if merging the bytes of both
by rank gives back just these two; as the merges on either side of the border don't depend
on anything further away, neighbours that are all compatible are the exact result of the
merges. Compatibility is remembered per pair of tokens.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from hearthbook.llm.common import map_batches, remembered, text_of, texts

#: Units of text that a worker remembers before it forgets those not used since the last time; pairs of tokens before it forgets them all.
MEMO_UNITS = 250_000
MEMO_PAIRS = 300_000
#: Texts that a worker holds ids of before it hands them on.
ROWS_AT_ONCE = 1_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file: lines of a base64 token and its rank."""
    with Path(path).open("rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge_halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of several bytes, the two tokens of which the last merge makes it."""
    halves = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                range(len(parts) - 1),
                key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank else rank,
            )
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks:
            halves[rank] = (ranks[parts[0]], ranks[parts[1]])
    return halves


def bytes_by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def decode_ids(bytes_of: list[bytes], ids: np.ndarray) -> bytes:
    """The bytes of an array of ids."""
    return b"".join(map(bytes_of.__getitem__, ids.tolist()))


class Codec:
    """Encodes by one vocabulary and one pattern."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]], pattern: str, by_units: bool = False):
        """by_units says that the pattern begins a piece at each blank before anything but white space."""
        self.ranks, self.halves, self.cut = ranks, halves, units if by_units else _whole
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = bytes_by_rank(ranks)
        self.sizes = list(map(len, self.bytes_of))
        self.names = list(map(str, range(len(self.bytes_of))))
        self.merged = {(a, b): rank for rank, (a, b) in halves.items()}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.matches = automaton.iter
        #: By token, the longest other entry that its bytes begin with; -1 if there is none.
        self.shorter = [-1] * len(self.bytes_of)
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:end]] for end in range(len(token) - 1, 0, -1) if token[:end] in ranks), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units = _Memo(self._of_unit)

    # ---- encoding

    def compatible(self, left: int, right: int) -> bool:
        known = self._stays_apart(left, right)
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, latest first, and look for one across the border.

        A merge of the parts that touch at the border would come before every merge undone
        so far if its rank is below theirs; then the border would not have lasted. Merges
        of one rank run from left to right, so on a tie the left side has gone first.
        """
        merged, halves = self.merged, self.halves
        bound = None
        while True:
            across = merged.get((left, right))
            if across is not None and (bound is None or across < bound):
                return False
            left_parts, right_parts = halves.get(left), halves.get(right)
            if left_parts is None and right_parts is None:
                return True
            if right_parts is None or (left_parts is not None and left > right):
                bound, left = left, left_parts[1]
            else:
                bound, right = right + 1, right_parts[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The token ids of one piece, as the merges in order of rank would leave them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        length, sizes, shorter, pairs = len(piece), self.sizes, self.shorter, self.pairs
        longest = [-1] * length  # by place; ends come in order, so the last match of a place stays
        for last, token in self.matches(piece.decode("latin-1")):
            longest[last + 1 - sizes[token]] = token
        open_ends = [True] * (length + 1)
        tokens: list[int] = []
        at, before, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                end = at + sizes[token]
                if open_ends[end]:
                    if before < 0:
                        break
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, before = end, token
                if at == length:
                    return tokens
                token = longest[at]
            else:
                open_ends[at] = False
                if not tokens:
                    raise ValueError(f"the vocabulary can't spell {piece!r}")
                token = tokens.pop()
                at -= sizes[token]
                before = tokens[-1] if tokens else -1
                token = shorter[token]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers.

        Under the default pattern a blank before anything but white space always begins a piece, whatever
        surrounds it, so the text falls into units at these blanks, and a unit's ids are remembered. Under
        any other pattern the text is cut as a whole, and the ids of its pieces are.
        """
        self.units.forget()
        return b"".join(map(self.units.__getitem__, self.cut(text)))

    def _of_unit(self, unit: str) -> bytes:
        pieces = self.pieces(unit)
        if pieces == [unit]:
            return array("i", self.encode_piece(unit.encode("utf-8", "surrogatepass"))).tobytes()
        return b"".join(map(self.units.__getitem__, pieces))


class _Memo(dict):
    """What make(unit) gives for short units; what isn't used again before the next time is forgotten."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self.make(unit)
        if len(unit) <= 64:
            self[unit] = found
        return found

    def forget(self) -> None:
        if len(self) > MEMO_UNITS:
            self.older = dict(self)
            self.clear()


def _whole(text: str) -> list[str]:
    return [text] if text else []


def units(text: str) -> list[str]:
    """Cut before each blank that is followed by anything but white space."""
    parts = text.split(" ")
    out = [parts[0]] if parts[0] else []
    gap = ""
    for part in parts[1:]:
        if part and not part[0].isspace():
            if gap:  # blanks before the one that begins this unit
                if out:
                    out[-1] += gap
                else:
                    out.append(gap)
                gap = ""
            out.append(" " + part)
        elif part:
            if out:
                out[-1] += gap + " " + part
            else:
                out.append(gap + " " + part)
            gap = ""
        else:
            gap += " "
    if gap:
        if out:
            out[-1] += gap
        else:
            out.append(gap)
    return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[int, tuple[int, int]]]:
    ranks = read_ranks(path)
    return ranks, merge_halves(ranks)


def _codec(shared, pattern: str) -> Codec:
    """The worker's codec for a broadcast vocabulary."""
    path, by_units, ranks, halves = shared.value
    return remembered(("byte_bpe", path, pattern), lambda: Codec(ranks, halves, pattern, by_units))


def _shared(docs: DataFrame, path: str, pattern: str):
    """The vocabulary for all executors: its size is that of the file, whatever the data."""
    return docs.sparkSession.sparkContext.broadcast((path, pattern == default_pattern(), *vocabulary(path)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of the whole text in one more column; null and empty texts have none.

    A column of that name is replaced. The vocabulary file is read by the driver.
    """
    vocab = _shared(docs, path, pattern)
    rows = docs.drop(out)
    kept = [f for f in rows.schema.fields]
    schema = StructType([*kept, StructField(out, ArrayType(IntegerType(), True))])

    def per_batch(batch: pa.RecordBatch) -> dict:
        codec = _codec(vocab, pattern)
        ends = [0]
        flat: list[np.ndarray] = []
        for t in texts(batch, text):
            ids = np.frombuffer(codec.encode_packed(t), np.int32)
            flat.append(ids)
            ends.append(ends[-1] + len(ids))
        values = np.concatenate(flat) if flat else np.empty(0, np.int32)
        made = {f.name: batch.column(f.name) for f in kept}
        made[out] = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(values))
        return made

    return map_batches(rows, per_batch, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for in one more column; null ids have none."""
    shared = docs.sparkSession.sparkContext.broadcast(bytes_by_rank(vocabulary(path)[0]))
    rows = docs.drop(out)
    kept = [f for f in rows.schema.fields]
    schema = StructType([*kept, StructField(out, BinaryType())])

    def per_batch(batch: pa.RecordBatch) -> dict:
        bytes_of = shared.value
        column = batch.column(ids)
        ends = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)
        made = {f.name: batch.column(f.name) for f in kept}
        made[out] = pa.array([decode_ids(bytes_of, values[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        return made

    return map_batches(rows, per_batch, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, and decoded again.

    Both happen in one pass over the texts, so a task needs one Python worker, not two.
    """
    vocab = _shared(docs, path, pattern)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def per_batch(batch: pa.RecordBatch) -> dict:
        codec = _codec(vocab, pattern)
        sizes, ids_digests, decoded_digests, flat = [], [], [], []
        for t in texts(batch):
            packed = np.frombuffer(codec.encode_packed(t), np.int32)
            ids = packed.tolist()
            sizes.append(len(ids))
            ids_digests.append(hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
            decoded_digests.append(hashlib.sha256(b"".join(map(codec.bytes_of.__getitem__, ids))).hexdigest())
            if with_ids:
                flat.append(packed)
        made = {"doc_id": batch.column("doc_id"), "n_tokens": sizes, "ids_sha256": ids_digests, "decoded_sha256": decoded_digests}
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return made

    return map_batches(rows, per_batch, schema, rows=ROWS_AT_ONCE)
