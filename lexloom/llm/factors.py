"""op6: exact removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of `length` bytes that covers it starts somewhere else
too. Candidates are found by winnowing: of the hashes of all GRAM-byte strings
inside a window of `length` bytes the smallest is the window's anchor, so
equal windows have equal anchors, at the same place. Windows whose anchor
occurs once are settled; the others are sent, each anchor with the bytes its
windows span, to the task of the anchor's hash.

There the suffixes that begin at the windows are put in order, to the depth
that matters, by prefix doubling; in suffix order the previous and next
smaller positions give each suffix its longest previous factor, and the
previous and next larger positions its longest later match, both measured up
to `length`. A window goes if either reaches `length` (or, to keep first
copies, if the previous factor does).

An anchor met more than CROWD times would make one task as large as its group;
its windows are dealt one by one, each to the group of its own content (a
64-bit hash), where each but the first has an earlier match of full length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .sketches import bucket_bits, levels, shared_buckets

LENGTH, GRAM = 400, 128
#: The windows of an anchor met more often are dealt one by one.
CROWD = 20_000
BATCH = 1 << 20
#: Bytes of text at a time: the arrays of winnowing take some eighty times as much.
PIECE = 1 << 20


class Suffixes:
    """Suffixes of a buffer, compared to a depth by ranks of their prefixes of 8, 16, 32 ... bytes (prefix doubling)."""

    def __init__(self, data: np.ndarray, depth: int):
        n = len(data)
        self.depth = depth
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.code = np.zeros(n, np.uint64)  # the next 8 bytes
        for k in range(8):
            self.code = self.code << np.uint64(8) | padded[k : k + n]
        self.ranks: list[tuple[int, np.ndarray]] = []
        have, rank = 8, np.unique(self.code, return_inverse=True)[1].astype(np.int32)
        while have <= depth:
            self.ranks.append((have, rank))
            if have * 2 > depth:
                break
            later = np.concatenate([rank[have:].astype(np.int64) + 1, np.zeros(min(have, n), np.int64)])[:n]
            rank, have = np.unique(rank * np.int64(n + 2) + later, return_inverse=True)[1].astype(np.int32), have * 2

    def order(self, at: np.ndarray) -> np.ndarray:
        """Indices of some positions in suffix order to the depth; suffixes that agree so far stand by position."""
        if not self.ranks:
            return np.lexsort((at, self.code[at] >> np.uint64(64 - 8 * self.depth)))
        have, rank = self.ranks[-1]
        return np.lexsort((at, rank[at + self.depth - have], rank[at]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes, to the depth."""
        length, last = np.zeros(len(a), np.int64), len(self.code) - 1
        for have, rank in reversed(self.ranks):
            x, y = np.minimum(a + length, last), np.minimum(b + length, last)
            length += have * (rank[x] == rank[y])
        x, y = np.minimum(a + length, last), np.minimum(b + length, last)
        differ = self.code[x] ^ self.code[y]
        for k in range(1, 8):
            length += differ < np.uint64(1) << np.uint64(64 - 8 * k)
        return np.minimum(length + (differ == 0), self.depth)


def neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place before and after each one with a smaller value; -1 and len(values) if there is none."""

    def before(v: np.ndarray) -> np.ndarray:
        v = np.append(v, v.min() - 1 if len(v) else 0)  # -1 stands for the place in front
        near = np.append(np.arange(-1, len(v) - 2), -1)
        far = np.flatnonzero(v[near[:-1]] > v[:-1])
        while len(far):  # all between a place and its candidate are larger: jump to the candidate's own
            near[far] = near[near[far]]
            far = far[v[near[far]] > v[far]]
        return near[:-1]

    return before(values), len(values) - 1 - before(values[::-1])[::-1]


def factors(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, to a depth, of the longest match of the suffix at each position (ascending) with one at an earlier and with one at a later position.

    In suffix order the longest earlier match of a suffix is with the previous
    or the next one of a smaller position, and its longest later match with
    the previous or the next one of a larger position.
    """
    suffixes = Suffixes(data, depth)
    order = suffixes.order(at)
    out = []
    for values in (order, -order):
        best = np.zeros(len(at), np.int64)
        for near in neighbours(values):
            some = np.flatnonzero((near >= 0) & (near < len(order)))
            here = order[some]
            best[here] = np.maximum(best[here], suffixes.common(at[here], at[order[near[some]]]))
        out.append(best)
    return out[0], out[1]


def repeated_starts(data: np.ndarray, at: np.ndarray, length: int, keep_first: bool) -> np.ndarray:
    """Which positions start a string of `length` bytes that starts earlier too (or later too, unless first copies are kept)."""
    earlier, later = factors(data, at, length)
    return earlier >= length if keep_first else np.maximum(earlier, later) >= length


def anchors(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Hash of each anchor of a segment, its text, and the first and last start of its windows."""
    n, none = len(data), (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if n < length:
        return none
    running = textkit.prefix_hash(data)
    grams = textkit.mix((running[gram:] - running[:-gram]) * textkit.powers(n + 1)[1][: n - gram + 1])
    width = length - gram + 1
    low = np.uint64(max(22, (n + 1).bit_length()))
    keys = grams >> low << low | np.arange(len(grams), dtype=np.uint64)
    rows = -(-len(keys) // width)
    grid = np.full(rows * width, ~np.uint64(0))
    grid[: len(keys)] = keys
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - length + 1], ahead[width - 1 : width - 1 + n - length + 1])
    place = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    starts = np.arange(n - length + 1)
    docs = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + length <= offsets[docs + 1]
    starts, place, docs = starts[valid], place[valid], docs[valid]
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (docs[1:] != docs[:-1]) | (np.diff(starts) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    hashes = textkit.mix(grams[place[first]] + np.uint64(0x9E3779B97F4A7C15))  # the smallest hashes crowd together: spread them again
    return hashes, docs[first], starts[first], starts[last]


def repeated_runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of hits."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def deduplicate(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, gram: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Texts without their repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null if nothing went).

    One row for each row with a doc_id; rows without one are left out, and
    their texts are not compared. Null and empty texts have 0 bytes. Strings
    are compared as bytes, never across texts; a repeated row is another text,
    and equal rows lose the same bytes. With keep_first the first copy, by
    (doc_id, position), stays. Other columns are ignored.
    """
    spark = docs.sparkSession
    gram = gram or min(GRAM, length)
    textkit.on_workers(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(n_bytes * 2 / (length - gram + 2) * 16)
    maps = shared_buckets(docs, lambda offsets, data: [anchors(offsets, data, length, gram)[0]], bits, (1, crowd), PIECE)
    crowded = bool(maps[1].any())
    bitmaps = spark.sparkContext.broadcast(maps)

    def candidates(batches):
        maps = bitmaps.value
        for batch in batches:
            for lo, hi, offsets, data in textkit.segments(batch.column(1), PIECE):
                hashes, at, first, last = anchors(offsets, data, length, gram)
                level = levels(maps, hashes, bits)
                use = level > 0
                hashes, at, first, last, many = hashes[use], at[use], first[use], last[use], level[use] > 1
                n = np.bincount(at, minlength=hi - lo)
                cut = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                ids = batch.column(0).slice(lo, hi - lo)
                raw = data.tobytes()
                running = textkit.prefix_hash(data)
                key = textkit.mix(textkit.range_hash(running, offsets[:-1], offsets[1:]) ^ textkit.mix(ids.to_numpy().view(np.uint64)))
                texts = [raw[a:b] if c else None for a, b, c in zip(offsets.tolist(), offsets[1:].tolist(), n.tolist())]
                sha = [None if c else hashlib.sha256(raw[a:b]).hexdigest() for a, b, c in zip(offsets.tolist(), offsets[1:].tolist(), n.tolist())]
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (hashes.view(np.int64), (first - offsets[at]).astype(np.int32), (last - offsets[at]).astype(np.int32), many)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(key.view(np.int64)), pa.array(np.diff(offsets)), pa.array(texts, pa.binary()), pa.array(sha, pa.string()), *lists], ["doc_id", "key", "n_bytes", "text", "sha", "anchor", "first", "last", "many"])

    rows = textkit.saved(docs.mapInArrow(candidates, "doc_id long, key long, n_bytes long, text binary, sha string, anchor array<long>, first array<int>, last array<int>, many array<boolean>"))
    texts = rows.where("text is not null")

    def contexts(batches):
        for batch in batches:
            out = []
            for doc, key, text, anchor, first, last, many in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(h, doc, key, a, b, text[a : b + length]) for h, a, b, m in zip(anchor, first, last, many) if not m]
                if len(out) > 20_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["anchor", "doc_id", "key", "first", "last", "bytes"])

    def kernel(batches):
        held, size, anchor = [], 0, None

        def flush():
            # equal contexts repeat each other whole; one of them is enough for what else they repeat
            seen: dict[tuple[int, bytes], int] = {}
            alone: list[tuple] = []
            whole = []
            for r in held:
                k = seen.setdefault((r[0], r[3]), len(alone))
                if k == len(alone):
                    alone.append([r, False])
                else:
                    whole.append(r)
                    alone[k][1] = True
            if not keep_first:
                whole += [r for r, twin in alone if twin]
            rows = [(r[1], r[2], r[2] + len(r[3])) for r in whole]
            shared = np.bincount([inverse for inverse in ids_of(alone)])
            alone = [x for x, g in zip(alone, ids_of(alone)) if shared[g] > 1]
            if alone:
                bytes_ = np.frombuffer(b"".join(r[3] for r, _ in alone), np.uint8)
                sizes = np.array([len(r[3]) for r, _ in alone])
                begin = np.cumsum(sizes) - sizes
                windows = sizes - length + 1
                at = textkit.gather(np.arange(len(bytes_)), begin, windows)
                hit = repeated_starts(bytes_, at, length, keep_first)
                fence = np.insert(hit, np.cumsum(windows)[:-1], False)  # runs end with their context
                a, b = repeated_runs(fence)
                member = np.insert(np.repeat(np.arange(len(alone)), windows), np.cumsum(windows)[:-1], -1)[a]
                base = (np.cumsum(windows) - windows + np.arange(len(alone)))[member]
                for m, x, y in zip(member.tolist(), (a - base).tolist(), (b - base).tolist()):
                    r = alone[m][0]
                    rows.append((r[1], r[2] + x, r[2] + y + length))
            held.clear()
            keys, begins, ends = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "begin": pa.array(begins, pa.int32()), "end": pa.array(ends, pa.int32())})

        def ids_of(rows):
            """Numbers of the rows' anchors."""
            number: dict[int, int] = {}
            return [number.setdefault(r[0], len(number)) for r, _ in rows]

        for batch in batches:
            anchors_, keys, firsts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for h, key, first, blob in zip(anchors_, keys, firsts, batch.column(5).to_pylist()):
                if h != anchor and size > BATCH:
                    yield flush()
                    size = 0
                anchor = h
                held.append((h, key, first, blob))
                size += len(blob)
        if held:
            yield flush()

    sent = spans_of(texts, contexts).repartition("anchor").sortWithinPartitions("anchor", "doc_id", "key", "first")
    found = sent.mapInArrow(kernel, "key long, begin int, end int")
    if crowded:
        found = found.union(crowd_windows(texts, length, keep_first))
    runs = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("runs"))

    def finish(batches):
        for batch in batches:
            out = []
            for doc, n, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                kept, spans, removed, done = [], 0, 0, 0
                stop = -1
                for r in runs or ():
                    a, b = r["begin"], r["end"]
                    if a > stop:
                        spans += 1
                        kept.append(text[done:a])
                        removed += b - a
                        stop = b
                    elif b > stop:
                        removed += b - stop
                        stop = b
                    done = stop
                kept = b"".join([*kept, text[done:]])
                out.append((doc, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if removed else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = texts.select("key", "doc_id", "n_bytes", "text").join(runs, "key", "left").select("doc_id", "n_bytes", "text", "runs").mapInArrow(finish, schema)
    zero = F.lit(0).cast("long")
    return changed.union(rows.where("text is null").select("doc_id", "n_bytes", zero, zero, "sha", F.lit(None).cast("binary")))


def spans_of(texts: DataFrame, contexts) -> DataFrame:
    schema = "anchor long, doc_id long, key long, first int, last int, bytes binary"
    return texts.select("doc_id", "key", "text", "anchor", "first", "last", "many").mapInArrow(contexts, schema)


def crowd_windows(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Repeated windows of crowded anchors, by counting window hashes; counts combine before they are shuffled."""

    def windows(batches):
        for batch in batches:
            for doc, key, text, first, last, many in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.concatenate([np.arange(a, b + 1) for a, b, m in zip(first, last, many) if m] or [np.zeros(0, np.int64)]).astype(np.int64)
                running = textkit.prefix_hash(np.frombuffer(text, np.uint8))
                h = textkit.range_hash(running, at, at + length)
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "doc_id": pa.array([doc] * len(at), pa.int64()), "key": pa.array([key] * len(at), pa.int64()), "begin": at.astype(np.int32)})

    rows = texts.where("exists(many, x -> x)").select("doc_id", "key", "text", "first", "last", "many").mapInArrow(windows, "h long, doc_id long, key long, begin int")
    twice = rows.groupBy("h").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "key", "begin")).alias("one")).where("m > 1")
    hit = rows.join(twice, "h")
    if keep_first:
        hit = hit.where("struct(doc_id, key, begin) <> one")
    return hit.select("key", "begin", (F.col("begin") + length).alias("end"))


def op6_lpf_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(textkit.documents(spark, sf_dir)).drop("kept")
