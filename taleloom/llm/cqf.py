"""Counting quotient filter over whole 64-bit fingerprints, as numpy arrays.

A fingerprint splits into a quotient (its high bits: the home slot) and a remainder (the rest,
stored). Remainders of one quotient form a sorted run; runs follow each other by linear probing;
one `occupied` bit per quotient and one `run end` bit per slot recover which run is whose. Since
quotient and remainder together are the fingerprint, a filter lists its fingerprints and counts
without loss, in order, and filters of any sizes merge into one. Counts above one stand beside the remainders, told by
a bit map (in place of counters coded into the slots).
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<BQQ")
_LOAD = 0.8


class CountingQuotientFilter:
    def __init__(self, qbits: int, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.qbits, self.occupied, self.run_end, self.remainders, self.counts = qbits, occupied, run_end, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Of uint64 fingerprints, repeats included; counts: how often each stands for."""
        fingerprints = np.asarray(fingerprints, dtype=np.uint64)
        counts = np.ones(len(fingerprints), dtype=np.int64) if counts is None else np.asarray(counts, dtype=np.int64)
        order = np.argsort(fingerprints, kind="stable")
        return cls._sorted(fingerprints[order], counts[order])

    @classmethod
    def _sorted(cls, fps: np.ndarray, counts: np.ndarray) -> CountingQuotientFilter:
        if len(fps):
            first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
            counts, fps = np.add.reduceat(counts, first), fps[first]
        qbits = max(3, int(np.ceil(np.log2(max(1, len(fps)) / _LOAD))))
        shift = np.uint64(64 - qbits)
        quotients = (fps >> shift).astype(np.int64)
        at = np.arange(len(fps))
        slots = np.maximum.accumulate(quotients - at) + at if len(fps) else at
        n = max(1 << qbits, int(slots[-1]) + 1 if len(fps) else 0)
        occupied, run_end = np.zeros(1 << qbits, dtype=bool), np.zeros(n, dtype=bool)
        occupied[quotients] = True
        if len(fps):
            run_end[slots[np.r_[quotients[1:] != quotients[:-1], True]]] = True
        return cls(qbits, occupied, run_end, fps & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints, ascending, and their counts. The remainders are kept without their empty
        slots: the bits tell where those are."""
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        starts = np.maximum(quotients, np.r_[0, ends[:-1] + 1]) if len(ends) else ends
        run = np.repeat(quotients.astype(np.uint64), ends - starts + 1)
        return (run << np.uint64(64 - self.qbits)) | self.remainders, self.counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the sums of the counts. Each filter lists its fingerprints in order, so the stable sort merges runs."""
        both = [f.items() for f in filters]
        if not both:
            return cls.of(np.zeros(0, dtype=np.uint64))
        fps, counts = np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
        order = np.argsort(fps, kind="stable")
        return cls._sorted(fps[order], counts[order])

    def dumps(self) -> bytes:
        """Bit maps, the remainders in as few whole bytes as hold them, and the counts above one."""
        many, octets = self.counts > 1, self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self._width(self.qbits)]
        maps = [np.packbits(x).tobytes() for x in (self.occupied, self.run_end, many)]
        return b"".join((_HEAD.pack(self.qbits, len(self.run_end), len(self.remainders)), *maps, octets.tobytes(), self.counts[many].tobytes()))

    @staticmethod
    def _width(qbits: int) -> int:
        return (64 - qbits + 7) // 8

    @classmethod
    def loads(cls, data: bytes) -> CountingQuotientFilter:
        qbits, slots, n = _HEAD.unpack_from(data)
        raw, at, bits = np.frombuffer(data, dtype=np.uint8, offset=_HEAD.size), 0, []
        for size in (1 << qbits, slots, n):
            bits.append(np.unpackbits(raw[at : at + (size + 7) // 8], count=size).astype(bool))
            at += (size + 7) // 8
        occupied, run_end, many = bits
        width = cls._width(qbits)
        octets = np.zeros((n, 8), dtype=np.uint8)
        octets[:, :width] = raw[at : at + n * width].reshape(n, width)
        counts = np.ones(n, dtype=np.int64)
        counts[many] = np.frombuffer(raw[at + n * width :].tobytes(), dtype=np.int64)
        return cls(qbits, occupied, run_end, octets.view("<u8").ravel().astype(np.uint64), counts)
