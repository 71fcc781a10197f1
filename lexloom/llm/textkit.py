"""Vectorised views of Arrow text columns, shared by the operators of this subpackage.

A batch of texts is one byte buffer plus offsets; words, lines and n-grams are
found and hashed over the whole buffer with numpy, so no Python object is made
for a word. Word hashes are 64-bit polynomial hashes (odd base, random byte
table, arithmetic modulo 2**64) followed by a mixing step.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text makes a segment of its own.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + (1 << 18))
        for k, base in enumerate((_BASE, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is an empty text."""
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def segments(column: pa.Array, limit: int = SEGMENT):
    """Row ranges of about `limit` bytes: (first row, end row, offsets, bytes)."""
    if not len(column):
        return
    offsets, data = text_buffer(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the words (runs without white space) of a segment."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside[1:-1] & (~inside[:-2] | cut[:-1])
    stop = inside[1:-1] & (~inside[2:] | cut[1:])
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, docs


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; slices of it give the hash of any byte range."""
    p, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_TABLE[data] * p[: len(data)], out=out[1:])
    return out


def range_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, q = powers(len(running))
    return mix((running[ends] - running[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, from the words' hashes; len(words) - n + 1 values."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix(h)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] of each (s, n), one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return values[at + np.arange(total)]


#: Workers outlive their tasks: with these, what they free beyond 32 MB goes back to the system.
MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Most bytes of a table that is broadcast.
BROADCAST = 24 << 20


def on_workers(spark) -> None:
    """Let Python workers that start from now on import this package and give freed memory back; the session hands them BATCH_ROWS rows at a time.

    Spark's own default counts rows, 10,000 of them, however long the texts
    are; a session that has another setting keeps it.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in [*env.get("PYTHONPATH", "").split(os.pathsep), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    env.update(MEMORY)


def shared_dir(spark) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Where it is unset, a folder of this machine serves if driver and executors
    are one process (local mode); on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{Path(os.environ.get('TMPDIR', '/tmp')).resolve()}/checkpoints"
    return f"{base.rstrip('/')}/lexloom-{uuid.uuid4().hex}"


def saved(df, path: str | None = None):
    """Write a DataFrame into the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.lexloom_path = path
    return out


def discard(*tables) -> None:
    """Delete the folders of saved tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "lexloom_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def free_name(columns: list[str], name: str) -> str:
    """A column name that a table doesn't have, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df, width: int):
    """A table of rows of `width` bytes at most, marked for broadcast if all of it has BROADCAST bytes at most; else as it is, for a shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * width <= BROADCAST else df


def documents(spark, sf_dir: str):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(doc_id, m: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode()) % m


class HashIndex:
    """An open-addressing table from 64-bit hashes to integers, looked up a whole array at a time."""

    def __init__(self, size: int = 1 << 16):
        self.used = 0
        self._make(size)

    def _make(self, size: int) -> None:
        self.shift = np.uint64(65 - size.bit_length())
        self.keys = np.zeros(size, np.uint64)
        self.values = np.zeros(size, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(_BASE) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert distinct new keys."""
        keys = np.where(keys == 0, np.uint64(1), keys)
        self.used += len(keys)
        if self.used * 2 > len(self.keys):
            old = self.keys > 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self._make(1 << int(3 * self.used).bit_length())
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 where there is none."""
        keys = np.where(keys == 0, np.uint64(1), keys)
        slot = self._slots(keys)
        cell, out = self.keys[slot], self.values[slot]
        wrong = np.flatnonzero(cell != keys)
        while len(wrong):
            empty = cell[wrong] == 0
            out[wrong[empty]] = -1
            wrong = wrong[~empty]
            slot[wrong] = (slot[wrong] + 1) & (len(self.keys) - 1)
            cell[wrong] = self.keys[slot[wrong]]
            hit = cell[wrong] == keys[wrong]
            out[wrong[hit]] = self.values[slot[wrong[hit]]]
            wrong = wrong[~hit]
        return out
