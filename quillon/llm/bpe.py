"""Byte-pair encoding and decoding with a contiguous rank array for each word.

A word of a text (by the tokenizer's pattern) is kept as its part boundaries and, in an array beside them, the rank of the
merge of each two adjacent parts. The array is scanned for its minimum, the boundary there is deleted, and the ranks of
the two neighbours are looked up again, until no adjacent parts have a rank. Words are short, so a scan of a few numbers
next to each other beats a heap; a word of more than ``LONG`` bytes (random data without spaces) has its candidates in a heap
instead, with the same result.

Encoding works on one row at a time: no shuffle. The ranks are a vocabulary file (tiktoken's format) whose path is a
parameter; they are read on the driver and broadcast, so their size doesn't depend on the data. Words that a worker has
seen lately are remembered.

Defined results: a null text has null tokens, an empty text no tokens; repeated rows get equal tokens each; null ids
are passed on; an empty table gives an empty table. In decoding, null tokens, an unknown number among them or a null
one give a null text; bytes that aren't UTF-8 become U+FFFD. Further columns pass through; a new column whose name is
taken gets underscores in front. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField

from quillon.llm.common import free, map_rows, quoted
from quillon.llm.grams import slices

#: How byte-level tokenizers of this family cut texts into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a word above which merges are found with a heap.
LONG = 200
#: Words that a worker remembers, in each of two generations.
REMEMBERED = 200_000
_NONE = 1 << 60


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a vocabulary file: name itself where it is a path, else the folder in PUBLIC_TOKENIZERS or /opt/tokenizers."""
    return name if os.path.sep in name else os.path.join(os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers"), name)


def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of a word by scans of a rank array."""
    get = ranks.get
    bounds = list(range(len(word) + 1))
    # near[i] is the rank of the merge of parts i and i + 1, that is of the bytes from bounds[i] to bounds[i + 2].
    near = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == _NONE:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of candidates over linked parts."""
    n, get = len(word), ranks.get
    end = list(range(1, n + 1))  # of the part that begins at i
    before = list(range(-1, n - 1))  # where the part before it begins
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = e
        if e < n:
            before[e] = i
            if (r := get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if before[i] >= 0 and (r := get(word[before[i] : e])) is not None:
            heapq.heappush(heap, (r, before[i], e))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encodes and decodes with a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.parts = {i: b for b, i in ranks.items()}
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def word(self, text: str) -> list[int]:
        got = self.old.get(text)
        if got is None:
            raw = text.encode()
            whole = self.ranks.get(raw)
            got = [whole] if whole is not None else merge_short(raw, self.ranks) if len(raw) <= LONG else merge_long(raw, self.ranks)
        if len(text) <= LONG:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        extend, word = out.extend, self.word
        for w in self.find(text):
            got = self.young.get(w)
            extend(word(w) if got is None else got)
        return out

    def decode(self, tokens: list[int]) -> str:
        return b"".join(map(self.parts.__getitem__, tokens)).decode("utf-8", errors="replace")


def _codecs(df: DataFrame, path: str, pattern: str):
    """A function that makes the codec in a worker, once."""
    ranks = df.sparkSession.sparkContext.broadcast(load(path))
    made: list[Codec] = []

    def codec() -> Codec:
        if not made:
            made.append(Codec(ranks.value, pattern))
        return made[0]

    return codec


def _lists(lists: list[list[int] | None]) -> pa.Array:
    sizes = np.array([0, *[len(x) if x is not None else 0 for x in lists]], dtype=np.int64).cumsum()
    flat = np.fromiter((t for x in lists if x is not None for t in x), dtype=np.int32, count=int(sizes[-1]))
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(flat), mask=pa.array([x is None for x in lists], pa.bool_()))


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", tokens_col: str = "tokens", pattern: str = PATTERN, check: bool = False) -> DataFrame:
    """``docs`` with the tokens of the text.

    check: with another column, ``round_trip``, that tells whether the decoded tokens are the text.
    """
    codec, place = _codecs(docs, path or vocabulary(), pattern), docs.columns.index(text_col)
    names = free(docs, *[tokens_col, "round_trip"][: 1 + check])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, part in slices(b.column(place)):
                texts = part.to_pylist()
                lists = [codec().encode(t) if t is not None else None for t in texts]
                made = [_lists(lists)]
                if check:
                    made.append(pa.array([codec().decode(x) == t if x is not None else None for x, t in zip(lists, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*b.slice(a, len(part)).columns, *made], [*b.schema.names, *names])

    kinds = [ArrayType(IntegerType()), BooleanType()]
    return map_rows(docs, run, [StructField(n, k) for n, k in zip(names, kinds)])


def decode(df: DataFrame, path: str | None = None, tokens_col: str = "tokens", text_col: str = "decoded", pattern: str = PATTERN) -> DataFrame:
    """``df`` with the text of the tokens."""
    codec, place = _codecs(df, path or vocabulary(), pattern), df.columns.index(tokens_col)
    (name,) = free(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x in b.column(place).to_pylist():
                known = x is not None and all(t in codec().parts for t in x)
                texts.append(codec().decode(x) if known else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, name])

    return map_rows(df, run, [StructField(name, StringType())])


def tokenised(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``tokens``, ``n_tokens`` and ``round_trip`` of each document."""
    only = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return encode(only, path, check=True).select("doc_id", "tokens", F.size("tokens").alias("n_tokens"), "round_trip")
