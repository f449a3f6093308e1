"""Packing: documents into sequences of near-equal length by Karmarkar-Karp multiway differencing.

A task streams its documents, so nothing is shuffled. It gathers pieces until they fill a group of windows, then divides
the group's pieces among them by differencing: every piece starts as a partial partition of its own, and the two partial
partitions with the largest imbalance are merged, the largest window of one with the smallest of the other, until one
partition is left. Where a window of it exceeds the capacity, the number of windows rises by one and the group is divided
anew. Whole windows of a long document go alone; its rest is cut at most at ``piece`` ids.

Null texts count as empty and have the end id alone. Repeated rows are packed as often as they come. Empty tables give no
sequences. A document's ids lie in exactly one piece each. Sequence ids are unique, not consecutive: the task's partition
in the upper bits. Memory: a group's ids and one batch of texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm._common import bounded_batches, column
from gridfold.llm.tokens import encoded

CAPACITY, END_ID = 4096, 2
#: Windows of a group, ids left free in each for the division to succeed, and the most ids of a rest in one piece.
WINDOWS, SLACK, PIECE = 256, 30, 512


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window (0 to k-1) of each size, and the windows' sums."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    left = np.full(n * k + n, -1, np.int32)
    right = np.full(n * k + n, -1, np.int32)
    nodes = n
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i in range(n):
        sums, tree = np.zeros(k, np.int64), np.full(k, -1, np.int32)
        sums[-1], tree[-1] = sizes[i], i
        heap.append((-int(sizes[i]), i, sums, tree))
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        sums, tb = a + b[::-1], tb[::-1]
        tree = np.where(ta < 0, tb, ta)
        both = np.flatnonzero((ta >= 0) & (tb >= 0))
        if len(both):
            own = np.arange(nodes, nodes + len(both), dtype=np.int32)
            left[own], right[own] = ta[both], tb[both]
            tree[both] = own
            nodes += len(both)
        order = np.argsort(sums, kind="stable")
        sums, tree = sums[order], tree[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), tie, sums, tree))
        tie += 1
    _, _, sums, tree = heap[0]
    window = np.full(nodes, -1, np.int64)
    window[tree[tree >= 0]] = np.flatnonzero(tree >= 0)
    for node in range(nodes - 1, n - 1, -1):
        window[left[node]] = window[right[node]] = window[node]
    return window[:n], sums


def divide(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each piece: as few windows as differencing can fill without exceeding the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return window
        k += 1


class _Packer:
    """Gathers a task's pieces and lays out full groups."""

    def __init__(self, capacity: int, windows: int, piece: int):
        self.capacity, self.piece = capacity, piece
        self.most = windows * max(1, capacity - SLACK) if capacity > 8 * SLACK else windows * capacity
        self.sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        self.pieces: list[tuple] = []
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.out.append((doc_id, at, self.capacity, ids[at : at + self.capacity], n, self.sequence, 0))
            self.sequence += 1
            at += self.capacity
        while at < n:
            take = min(n - at, self.piece, self.most - self.held)
            self.pieces.append((doc_id, at, take, ids[at : at + take], n))
            self.held += take
            at += take
            if self.held == self.most:
                self.lay()

    def lay(self) -> None:
        if not self.pieces:
            return
        sizes = np.array([p[2] for p in self.pieces], np.int64)
        window = divide(sizes, self.capacity)
        used = np.unique(window)
        offset = dict.fromkeys(used.tolist(), 0)
        name = {w: self.sequence + k for k, w in enumerate(used.tolist())}
        for piece, w in zip(self.pieces, window.tolist(), strict=True):
            self.out.append((*piece, name[w], offset[w]))
            offset[w] += piece[2]
        self.sequence += len(used)
        self.pieces, self.held = [], 0

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        done, self.out = self.out, []
        for lo in range(0, len(done), 4000):
            doc, start, length, ids, total, sequence, offset = zip(*done[lo : lo + 4000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, schema.field(0).type), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([np.asarray(x, "<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema=schema)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, windows: int = WINDOWS, piece: int = PIECE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    docs needs doc_id and text; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, windows, piece)
        for batch in batches:
            names, texts = column(batch, "doc_id").to_pylist(), column(batch, "text")
            for lo, ids, ends in encoded(texts, tokenizer, end_id):
                start = 0
                for k, end in enumerate(ends.tolist()):
                    packer.add(names[lo + k], ids[start:end])
                    start = end
                yield from packer.rows(schema)
        packer.lay()
        yield from packer.rows(schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, ids, and padded ids of a packing; a sequence whose length is a power of two is not padded."""
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return lengths.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(exact, 0).otherwise(capacity - F.col("n"))).alias("padded"))


