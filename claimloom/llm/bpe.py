"""Byte-level BPE with a contiguous rank array.

A text is cut into short words by the tokenizer's pattern. A word's parts are a list of ids beside a list with the rank of
each adjacent pair; the smallest rank is looked up, its boundary deleted and the ranks of its neighbours refreshed, until no
pair can merge. Words over LONG bytes use the same rule with a heap in place of the scan, so a very long word costs
n log n. Equal words are merged once per worker.

The vocabulary is read by the driver from a path that is a parameter, and sent to the executors; it has a fixed size.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text. Special tokens that stand
in a text become their own id. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.words import slices
from claimloom.session import spread

#: Bytes from which on a word's pairs are held in a heap.
LONG = 256
#: Distinct words in a generation of those whose ids a worker keeps.
KNOWN = 100_000
#: Fixed values of the byte-level format: how a text is cut, and which bytes stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_NONE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next of the letters from 256 on."""
    rest = [b for b in range(256) if b not in PLAIN]
    return {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Words and their ids as bytes; a word that isn't there is merged. Two generations are kept: when the younger is full
    it becomes the older, from which words that occur again come back, and the rest is forgotten.
    """

    def __init__(self, merge: Callable[[bytes], list[int]]):
        super().__init__()
        self.merge = merge
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.merge(word.encode())).tobytes()
        if len(word) <= LONG:
            if len(self) >= KNOWN:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Coder:
    """Encodes and decodes with one vocabulary, given as the bytes of a tokenizer's JSON file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        #: Rank of each pair of ids, and the id that the pair of a rank becomes.
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault((vocab[left], vocab[right]), rank)
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = _Known(self.merge)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        rank, merged = self.ranks.get, self.merged
        ids = [self.first[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        ranks = [rank(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]), _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            low, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = self.merged[low], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := rank((ids[a], ids[b]), _NONE)) != _NONE:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as unsigned 32-bit integers of this machine."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else (text,)
        return b"".join(array("I", [self.special[part]]).tobytes() if part in self.special else b"".join(map(self.known.__getitem__, self.words.findall(part))) for part in parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


_coders: dict[int, Coder] = {}


def _coder(sent) -> Coder:
    if sent.id not in _coders:
        _coders.clear()
        _coders[sent.id] = Coder(sent.value)
    return _coders[sent.id]


class _Sent:
    """A broadcast vocabulary with the number by which a worker knows it."""

    def __init__(self, df: DataFrame, path: str):
        raw = Path(path).read_bytes()
        self.id, self.held = hash(raw), df.sparkSession.sparkContext.broadcast(raw)

    @property
    def value(self) -> bytes:
        return self.held.value


def _little(ids: bytes) -> bytes:
    """From this machine's order of bytes to little-endian, and back."""
    if sys.byteorder == "little":
        return ids
    swapped = array("I", ids)
    swapped.byteswap()
    return swapped.tobytes()


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"the table has a column {name}; name another")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs and their ids in ids_col: a binary of little-endian unsigned 32-bit integers."""
    sent = _Sent(docs, path)
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = pa.array([_little(coder.encode(x or "")) for x in batch.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_col])
        coder.known.older = {}  # the worker waits for other work

    return spread(docs).mapInArrow(of, _with(docs, ids_col, T.BinaryType()))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded and the texts of its ids in text_col."""
    sent = _Sent(encoded, path)
    at = encoded.columns.index(ids_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for batch in batches:
            texts = [coder.decode(_little(ids or b"")) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return encoded.mapInArrow(of, _with(encoded, text_col, T.StringType()))


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with their ids and the texts that these decode to, in one pass: one worker and one vocabulary for each core."""
    sent = _Sent(docs, path)
    at = docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for whole in batches:
            for batch in slices(whole, text_col):
                ids = [coder.encode(x or "") for x in batch.column(at).to_pylist()]
                columns = [*batch.columns, pa.array(map(_little, ids), pa.binary()), pa.array(map(coder.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, ids_col, decoded_col])
        coder.known.older = {}  # the worker waits for other work

    schema = _with(docs, ids_col, T.BinaryType())
    return spread(docs).mapInArrow(of, T.StructType([*schema.fields, T.StructField(decoded_col, T.StringType())]))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of every row."""
    coded = encode_and_decode(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path)
    return coded.select(
        F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
