"""Best-fit packing of documents into bins of a fixed size (in characters, or in what else ``size`` counts, such as tokens), by matching of the large items.

No bin holds three items above a third of its capacity, so these are matched in pairs: from the largest on, each takes
the largest one left that fits beside it, or stays alone. The smaller items then go, from the largest on, where the gap
that fits is the smallest; a new bin is opened where none fits. A document longer than a bin is cut into pieces that fill
bins of their own, and a rest that is an item like others; nothing is left out.

Only ids and lengths are moved. Items are packed in shards by hash, so many that one holds ``shard_items`` of the items on
average, or ``shard_chars`` of the characters if that gives more: the number grows with the data, a shard doesn't, and each leaves
a few bins partly filled, which doesn't count among its thousands.

Defined results: documents with null or empty text have no characters and no row; rows without an id are packed like others;
repeated rows are items of their own; ties in size go by id (null ids last), then by hash of the text, and items that are equal in all of
these can be exchanged without a difference; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import quoted, written

CAPACITY = 32_768
SHARD_CHARS = 500_000_000
SHARD_ITEMS = 200_000


class Gaps:
    """The bins by free characters, with the least gap of at least some size in a few steps."""

    def __init__(self, capacity: int) -> None:
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        # A set of bits in blocks of 1024: whole tells which blocks have any.
        self.blocks = [0] * (capacity // 1024 + 1)
        self.whole = 0

    def put(self, gap: int, b: int) -> None:
        if not self.bins[gap]:
            self.blocks[gap >> 10] |= 1 << (gap & 1023)
            self.whole |= 1 << (gap >> 10)
        self.bins[gap].append(b)

    def take(self, size: int) -> tuple[int, int] | None:
        """(gap, bin) of the best fit, which is removed."""
        block = size >> 10
        bits = self.blocks[block] >> (size & 1023)
        if bits:
            gap = size + ((bits & -bits).bit_length() - 1)
        else:
            rest = self.whole >> (block + 1)
            if not rest:
                return None
            block += (rest & -rest).bit_length()
            gap = (block << 10) + ((self.blocks[block] & -self.blocks[block]).bit_length() - 1)
        b = self.bins[gap].pop()
        if not self.bins[gap]:
            block = gap >> 10
            self.blocks[block] &= ~(1 << (gap & 1023))
            if not self.blocks[block]:
                self.whole &= ~(1 << block)
        return gap, b


def assign(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each item. sizes: from 1 to capacity, in falling order."""
    n = len(sizes)
    bins, begins = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    large = int(np.searchsorted(-sizes, -(capacity // 3), side="left"))  # items above a third come first
    # left[i] leads to the first item from i on that is not matched.
    left = list(range(large + 1))

    def free(i: int) -> int:
        while left[i] != i:
            left[i] = left[left[i]]
            i = left[i]
        return i

    gaps, count = Gaps(capacity), 0
    fits = np.searchsorted(-sizes[:large], -(capacity - sizes[:large]), side="left").tolist()  # the first item small enough
    size = sizes.tolist()
    for i in range(large):
        if left[i] != i:
            continue
        left[i] = i + 1
        bins[i], gap = count, capacity - size[i]
        j = free(max(i + 1, fits[i]))
        if j < large:
            left[j] = j + 1
            bins[j], begins[j] = count, size[i]
            gap -= size[j]
        gaps.put(gap, count)
        count += 1
    for i in range(large, n):
        found = gaps.take(size[i])
        if found is None:
            found = capacity, count
            count += 1
        gap, b = found
        bins[i], begins[i] = b, capacity - gap
        gaps.put(gap - size[i], b)
    return bins, begins


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard_chars: int = SHARD_CHARS, shard_items: int = SHARD_ITEMS, size: Column | None = None) -> DataFrame:
    """Where the pieces of the documents go: ``doc_id``, ``piece``, ``begin`` and ``size`` in the text, ``bin``, ``place`` in the bin.

    size: of a document, where it isn't the number of characters.
    """
    text = quoted(text_col)
    items = written(docs.select(quoted(id_col).alias("i"), F.coalesce((F.length(text) if size is None else size).cast("int"), F.lit(0)).alias("n"), F.xxhash64(text).alias("h")).filter("n > 0"), "items")
    # Full pieces need no packing, so a shard's size is that of what needs it.
    rests = F.col("n") % capacity
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(rests), F.lit(0))).first()
    shards = max(1, ceil(chars / shard_chars), ceil(count / shard_items))
    sharded = items.withColumn("s", F.pmod(F.xxhash64("i", "h"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("i", "ascending"), ("h", "ascending")])
        lengths = table.column("n").to_numpy().astype(np.int64)
        full, rest = lengths // capacity, lengths % capacity
        order = np.flatnonzero(rest > 0)
        order = order[np.argsort(-rest[order], kind="stable")]
        bins, begins = assign(rest[order], capacity)
        # Whole pieces have bins after those.
        whole = np.repeat(np.arange(len(lengths)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        first = int(bins.max()) + 1 if len(bins) else 0
        row = np.concatenate([order, whole])
        shard = table.column("s")[0].as_py()
        piece = np.concatenate([full[order], piece])
        return pa.table(
            {
                "doc_id": table.column("i").take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "begin": pa.array((piece * capacity).astype(np.int32)),
                "size": pa.array(np.concatenate([rest[order], np.full(len(whole), capacity)]).astype(np.int32)),
                "bin": pa.array((shard << 32) + np.concatenate([bins, first + np.arange(len(whole))])),
                "place": pa.array(np.concatenate([begins, np.zeros(len(whole), dtype=np.int64)]).astype(np.int32)),
            }
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return sharded.groupBy("s").applyInArrow(run, f"doc_id {kind}, piece int, begin int, size int, bin bigint, place int")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``bins``, and the share of them that is ``filled``."""
    return packed.groupBy("bin").agg(F.sum("size").alias("size")).agg(F.count("*").alias("bins"), (F.sum("size") / (F.count("*") * capacity)).alias("filled"))


def sequences(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", capacity: int = 2048, shard_chars: int = SHARD_CHARS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The packed sequences themselves, of documents with arrays of tokens: ``bin``, ``tokens``, and of each piece the document (``doc_ids``) and where it begins (``starts``).

    Rows get numbers of their own first, so repeated ids do no harm. Each token is shuffled twice, to its number and to its bin.
    """
    rows = written(docs.select(quoted(id_col).alias("i"), quoted(tokens_col).alias("x")).filter(F.size("x") > 0).withColumn("row", F.monotonically_increasing_id()), "tokens")
    placed = pack(rows, "row", "i", capacity, shard_chars, shard_items, F.size("x")).withColumnRenamed("doc_id", "row")
    pieces = placed.join(rows, "row").select("bin", F.struct("place", "i", F.slice("x", F.col("begin") + 1, F.col("size")).alias("x")).alias("p"))
    whole = pieces.groupBy("bin").agg(F.sort_array(F.collect_list("p")).alias("p"))  # no more than the capacity
    return whole.select("bin", F.flatten("p.x").alias("tokens"), F.col("p.i").alias("doc_ids"), F.col("p.place").alias("starts"))
