"""Best-fit packing of documents into training sequences, under conflicts of source and of duplicate cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlake.llm.mixing import size_of

#: Words of a sequence, and documents that are packed together.
CAPACITY, BLOCK = 2048, 4096


class Bins:
    """Open bins by residual capacity. An integer's bits mark the residuals that have bins, so that the successor of a size is a bit scan."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The tightest bin with room and without a conflict, or a new one: its number and the start inside it. `source` and `cluster` are bits, 0 for none."""
        left = self.some >> size
        residual = size
        while left:
            skip = (left & -left).bit_length() - 1
            residual += skip
            left >>= skip
            for k, b in enumerate(self.at[residual]):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self.at[residual].pop(k)
                    if not self.at[residual]:
                        self.some &= ~(1 << residual)
                    return b, self._put(b, residual, size, source, cluster)
            left >>= 1
            residual += 1
        self.sources.append(0)
        self.clusters.append(0)
        b = len(self.sources) - 1
        return b, self._put(b, self.capacity, size, source, cluster)

    def _put(self, b: int, residual: int, size: int, source: int, cluster: int) -> int:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        rest = residual - size
        if rest:
            self.at[rest].append(b)
            self.some |= 1 << rest
        return self.capacity - residual


def pack_block(sizes: list[int], sources: list[str | None], clusters: list[int | None], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row, part, words, bin, start) of one block, longest remainders first. A longer document fills bins of its own and its rest is packed."""
    bit: dict[str | None, int] = {}
    for s in sources:
        bit.setdefault(s, 1 << len(bit))
    seen, twice = set(), {}
    for c in clusters:
        if c is not None and c in seen:
            twice.setdefault(c, 1 << len(twice))
        seen.add(c)
    bins, out = Bins(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: -(sizes[k] % capacity or capacity)):
        parts = [capacity] * (sizes[k] // capacity) + [sizes[k] % capacity] * (sizes[k] % capacity > 0)
        for part, size in enumerate(parts):
            b, start = bins.place(size, bit[sources[k]], twice.get(clusters[k], 0))
            out.append((k, part, size, b, start))
    return out


def pack(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", capacity: int = CAPACITY, block: int = BLOCK, cluster: str | None = None) -> DataFrame:
    """(doc_id, part, n_words, source, cluster, bin_id, start): where each part of each document stands in the packed sequences.

    No bin holds more than `capacity` words, two documents of one source, or two of one duplicate cluster: equal texts, or equal values of the column
    `cluster` where one is named (a near-duplicate class, say; rows without one are in no cluster).
    A document of more words than that fills whole bins with its first parts. Documents without words, null texts among them, have no row. A null
    source is a source like any other, ids may have any type and be null. Repeated rows are documents of one cluster.

    Documents are dealt by a hash of id and text to blocks of about `block`, whatever their source or cluster; each block is packed on its own, so
    that memory stays bounded. A block sees conflicts only inside its own bins, and no bin spans blocks. Ties in size are placed in the order of the deal.
    """
    own = F.xxhash64(F.col(text)) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(F.col(cluster)))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), own.alias("cluster"), F.xxhash64(F.col(doc_id), F.col(text)).alias("deal"), size_of(F.col(text)).alias("n_words"))
    parts = max(1, -(-docs.count() // block))
    dealt = narrow.repartition(parts, "deal").sortWithinPartitions("deal", "source", "n_words").withColumn("place", F.spark_partition_id())
    kind = dict(narrow.dtypes)["doc_id"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        # texts without words go here: a filter in the plan would move below the count and evaluate it again, in a Python worker more
        for rows in _blocks((b.filter(pc.greater(b.column("n_words"), 0)) for b in batches), block):
            names, clusters, sizes = (rows.column(c).to_pylist() for c in ("source", "cluster", "n_words"))
            done = pack_block(sizes, names, clusters, capacity)
            base = (rows.column("place")[0].as_py() << 40) + (number << 20)
            number += 1
            at = pa.array([x[0] for x in done], pa.int64())
            ids = rows.column("doc_id").combine_chunks().take(at)
            yield pa.record_batch([
                ids, pa.array([x[1] for x in done], pa.int32()), pa.array([x[2] for x in done], pa.int64()), pa.array([names[x[0]] for x in done], pa.string()),
                pa.array([clusters[x[0]] for x in done], pa.int64()), pa.array([base + x[3] for x in done], pa.int64()), pa.array([x[4] for x in done], pa.int64()),
            ], names=["doc_id", "part", "n_words", "source", "cluster", "bin_id", "start"])

    return dealt.mapInArrow(packed, f"doc_id {kind}, part int, n_words bigint, source string, cluster bigint, bin_id bigint, start bigint")


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Tables of twice `block` rows at most, so that one deal is nearly always one block."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, 2 * block - n)
            batch = batch.slice(take.num_rows)
            held.append(take)
            n += take.num_rows
            if n == 2 * block:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
