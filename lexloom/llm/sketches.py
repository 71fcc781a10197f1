"""Which hashes of a corpus occur more than once, told by a table of counters of fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit

SLICES = 64
#: Hashes that a task holds before it sends them.
HELD = 1_500_000


def shared_buckets(docs: DataFrame, hashes, bits: int, steps: tuple[int, ...], piece: int = textkit.SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Levels of 2**bits buckets of hashes, as two bitmaps (the low and the high bit): how many of the ascending `steps`, three at most, a bucket's count exceeds.

    hashes(offsets, bytes) gives the hash arrays of a segment of `text`. All
    texts are counted. Tasks send each hash as the few bytes of its bucket;
    the buckets are cut into SLICES slices, summed apart from each other in
    memory that depends on bits alone. Two hashes in one bucket can only make
    a level higher than it is.
    """
    low = bits - SLICES.bit_length() + 1  # bits of a bucket inside its slice

    def emit(batches):
        held, size = [], 0

        def flush():
            buckets = np.sort(np.concatenate(held) >> np.uint64(64 - bits))
            cut = np.searchsorted(buckets >> np.uint64(low), np.arange(SLICES + 1))
            inside = (buckets & np.uint64((1 << low) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, : (low + 7) // 8]
            held.clear()
            return pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "buckets": pa.array([inside[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

        for batch in batches:
            for _, _, offsets, data in textkit.segments(batch.column(0), piece):
                sets = [x for x in hashes(offsets, data) if len(x)]
                if sets:
                    held.append(np.concatenate(sets))
                    size += len(held[-1])
                    if size > HELD:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    def add(batches):
        width, counts = (low + 7) // 8, {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, width)
                at = np.zeros((len(raw), 4), np.uint8)
                at[:, :width] = raw
                at = at.reshape(-1).view("<u4") if len(raw) else np.zeros(0, np.uint32)
                count = counts.setdefault(k, np.zeros(1 << low, np.uint16))
                u, n = np.unique(at, return_counts=True)
                count[u] = np.minimum(count[u].astype(np.int64) + n, 65535)
        for k, count in counts.items():
            level = sum((count > x).astype(np.uint8) for x in steps)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "low": pa.array([np.packbits(level & 1).tobytes()], pa.binary()), "high": pa.array([np.packbits(level >> 1).tobytes()], pa.binary())})

    lows, highs = np.zeros(1 << bits >> 3, np.uint8), np.zeros(1 << bits >> 3, np.uint8)
    step = 1 << low >> 3
    rows = docs.select("text").mapInArrow(emit, "slice int, buckets binary").repartition("slice").mapInArrow(add, "slice int, low binary, high binary")
    for k, a, b in rows.collect():  # SLICES rows of a fixed size
        lows[k * step : (k + 1) * step] = np.frombuffer(a, np.uint8)
        highs[k * step : (k + 1) * step] = np.frombuffer(b, np.uint8)
    return lows, highs


def bucket_bits(n: float) -> int:
    """About one bucket for each of n hashes, 2**30 at most: both bitmaps take 256 MB then, and less below."""
    return min(30, max(20, int(n).bit_length()))


def levels(bitmaps: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, bits: int) -> np.ndarray:
    """The level of each hash's bucket, 0 to 3."""
    bucket = hashes >> np.uint64(64 - bits)
    byte, bit = bucket >> np.uint64(3), (np.uint64(7) - (bucket & np.uint64(7))).astype(np.uint8)
    return (bitmaps[0][byte] >> bit & 1) + 2 * (bitmaps[1][byte] >> bit & 1)
