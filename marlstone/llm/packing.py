"""Bounded-space online best-fit packing of documents into training sequences.

Documents arrive in the order of doc_id within a shard. At most ``open_bins`` bins are open. A bitset holds one bit
for each amount of free space that some open bin has, so the best fit (the least free space that suffices) is one
shift and one lowest-set-bit. If nothing fits, a bin is opened; if that makes too many, the fullest closes first.
A document longer than a bin is cut into whole bins and a remainder, which is packed like any document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokencount
from marlstone.llm.common import durable, lean

CAPACITY, OPEN_BINS, SHARD_ROWS = 4096, 64, 20_000
SCHEMA = "doc_id bigint, piece int, n_tokens bigint, bin_id bigint, bin_offset int"


class Packer:
    def __init__(self, capacity: int, open_bins: int, first_bin: int = 0):
        self.capacity, self.most, self.next_bin = capacity, open_bins, first_bin
        self.bits, self.by_free, self.open = 0, {}, 0  # by_free: free space -> bins, the oldest first

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop(0)
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def _new(self) -> int:
        self.next_bin += 1
        return self.next_bin - 1

    def add(self, size: int) -> tuple[int, int]:
        """Bin and offset of a piece of 1 to ``capacity`` tokens."""
        if size == self.capacity:
            return self._new(), 0
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            place = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, place = self.capacity, self._new()
        if free > size:
            left = free - size
            self.by_free.setdefault(left, []).append(place)
            self.bits |= 1 << left
            self.open += 1
        return place, self.capacity - free


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_rows: int = SHARD_ROWS, vocabulary: str = tokencount.VOCABULARY) -> DataFrame:
    """Rows (doc_id, piece, n_tokens, bin_id, bin_offset): each piece of each document and its place in a bin.

    Lengths are exact token counts of whole texts. Shards are made by a hash of doc_id and length, about ``shard_rows``
    rows each, and packed side by side; bin_id is the shard times 2**32 plus a count, so bins never mix shards. Within a
    shard the order is doc_id (null first), then length; documents that tie are alike for packing. A null or empty
    text has nothing to pack: one row with n_tokens 0 and no bin. A very long text makes as many pieces as it fills bins.
    Repeated rows are packed each. An empty table gives no rows. Other columns are ignored, whatever their names. Only
    ids and lengths are shuffled; a shard is streamed, and what a task holds is its open bins.
    """
    if capacity < 1 or open_bins < 1 or shard_rows < 1:
        raise ValueError("capacity, open_bins and shard_rows must be positive")
    sized = durable(tokencount.counts(docs, vocabulary).select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    shards = max(1, -(-sized.count() // shard_rows))
    keyed = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).cast("int"))

    def work(batches):
        shard, packer = None, None
        for batch in batches:
            rows = []
            for doc, n, s in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "shard"))):
                if s != shard:
                    shard, packer = s, Packer(capacity, open_bins, s << 32)
                if not n:
                    rows.append((doc, 0, 0, None, None))
                    continue
                piece = 0
                while n:
                    size = min(n, capacity)
                    rows.append((doc, piece, size, *packer.add(size)))
                    n, piece = n - size, piece + 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset"])

    return keyed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n_tokens").mapInArrow(lean(work), SCHEMA)
