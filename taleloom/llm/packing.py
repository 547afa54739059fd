"""Best-fit packing of token sequences, in rounds that the driver plans.

Pieces are range-sorted by length over the cluster and ranked within each length. A round gives the unplaced pieces of
one length to the smallest gaps that hold them (their successor among the gap sizes). Equal pieces want the same
gap: the piece of rank r gets the r-th gap, so no two get one. What a round fills comes back as smaller gaps, and
rounds go on until every piece of that length has a place, the longest first.

There are no sweeps over gaps on the cluster. Equal pieces and equal gaps are interchangeable, so a round moves runs of
them at once: a range of ranks that takes its places in a range of sequences. The runs depend on the lengths (at
most `capacity` different ones), not on the number of pieces, so one process on the driver plans them from
the counts by length, and each piece finds its place from its length and rank, on its own executor.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taleloom.llm.common import documents, materialise
from taleloom.llm.tokens import TextEncoder

CAPACITY = 1024
END = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end: int | None = END, capacity: int = CAPACITY) -> DataFrame:
    """Tokenised documents, cut into pieces: (doc_id, piece, start, length, ids_crc32). Only documents longer than
    `capacity` are cut; then the first piece is the one that may be shorter. A null text is empty; a
    document without any id (only where `end` is None) is one piece of length 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(vocabulary)
        tail = b"" if end is None else int(end).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + tail
                n, start, piece = len(ids) // 4, 0, 0
                while True:
                    size = (n - start - 1) % capacity + 1 if n > start else 0
                    rows.append((doc_id, piece, start, size, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])))
                    start, piece = start + size, piece + 1
                    if start >= n:
                        break
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs).mapInArrow(cut, _PIECES)


class Plan:
    """Runs by length: for each, the first rank, the first sequence and the place in it."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        self.sequences = 0
        gaps: dict[int, deque[tuple[int, int]]] = {}  # size: ranges of sequences (first, number)
        sizes: list[int] = []  # of those, sorted

        def put(size: int, first: int, number: int) -> None:
            if size:
                if size not in gaps:
                    gaps[size] = deque()
                    insort(sizes, size)
                gaps[size].append((first, number))

        for length in sorted((x for x in counts if x > 0), reverse=True):
            rank, left, runs = 0, counts[length], self.runs.setdefault(length, [])
            while left:
                at = bisect_left(sizes, length)  # the successor
                if at == len(sizes):  # no gap holds it: as many new sequences as these pieces fill
                    number = -(-left // (capacity // length))
                    put(capacity, self.sequences, number)
                    self.sequences += number
                    continue
                size = sizes[at]
                first, number = gaps[size].popleft()
                taken = min(number, left)
                if taken < number:
                    gaps[size].appendleft((first + taken, number - taken))
                if not gaps[size]:
                    del gaps[size], sizes[at]
                runs.append((rank, first, capacity - size))
                rank, left = rank + taken, left - taken
                put(size - length, first, taken)
        if counts.get(0):  # nothing to place: the first sequence, at its start
            self.runs[0] = [(0, 0, 0)]
            self.sequences = max(1, self.sequences)

    def arrays(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) for length, runs in self.runs.items()}


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a sorted partition: the rank among its rows of the same length."""
    before, last = 0, -1
    for batch in batches:
        length = batch.column("length").to_numpy()
        n = len(length)
        if not n:
            continue
        first = np.maximum.accumulate(np.where(np.r_[True, length[1:] != length[:-1]], np.arange(n), 0))
        rank = np.arange(n) - first
        if int(length[0]) == last:
            rank[: int(np.searchsorted(-length, -length[0], side="right"))] += before
        before, last = int(rank[-1]) + 1, int(length[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "rank"])


def _placed(plan: dict, before: dict[tuple[int, int], int]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, part, rank = (batch.column(x).to_numpy() for x in ("length", "part", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                whole = rank[at] + np.array([before[int(p), int(size)] for p in part[at]], dtype=np.int64)
                ranks, firsts, offsets = plan[int(size)]
                run = np.searchsorted(ranks, whole, side="right") - 1
                sequence[at] = np.where(size == 0, 0, firsts[run] + whole - ranks[run])
                offset[at] = offsets[run]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return place


def best_fit(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (as pieces() returns them) with sequence_id and offset: each in one sequence of at most
    `capacity` tokens, gapless from 0. Ties in length go by doc_id, then piece. No rows give no rows."""
    parts = materialise(parts, "pieces")
    keys = [F.desc("length"), "doc_id", "piece", "start", "ids_crc32"]
    ranked = parts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    ranked = materialise(ranked.mapInArrow(_ranked, f"{_PIECES}, part int, rank long"), "ranked")
    # Range-sorted, a length spans neighbouring partitions: one row for each partition and length, at most
    # as many as partitions and lengths together.
    counts, before = {}, {}
    for row in sorted(ranked.groupBy("part", "length").count().collect()):
        before[row["part"], row["length"]] = counts.get(row["length"], 0)
        counts[row["length"]] = counts.get(row["length"], 0) + row["count"]
    plan = Plan(counts, capacity)
    return ranked.mapInArrow(_placed(plan.arrays(), before), f"{_PIECES}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """All documents as pieces with their places: pieces() and then best_fit()."""
    return best_fit(pieces(docs, vocabulary, end, capacity), capacity)
