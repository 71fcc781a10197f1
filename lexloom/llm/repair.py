"""op4: token ids in Re-Pair compressed shards.

Texts are encoded, range-partitioned by doc_id and written as blocks. A block
holds its own grammar: in each round the id pairs of the block are counted
exactly, and the most frequent are replaced by new nonterminals (overlapping
occurrences: every other one, from the left). Rounds go on until no pair occurs
LEAST times or a round gains less than GAIN. Pairs never contain the end id, so no rule crosses a document. Stored are the
rules, the length of each expansion, the sequence, and for each document its
place in the sequence and its token count, so one document can be decoded
without the others.

Block layout, little endian: magic LXRP0001; int64 counts (documents, rules,
terminals, sequence, width of a symbol in bytes); doc_id int64[documents];
sequence start uint32[documents + 1]; token count uint32[documents]; rule
left, right, expansion length uint32[rules]; sequence.
"""

from __future__ import annotations

import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens, textkit

MAGIC = b"LXRP0001"
BLOCK_IDS = 1 << 20
#: A pair met less often would cost more as a rule (three numbers) than it saves.
LEAST = 4
#: Rules made from one count of all pairs; the next round counts anew.
RULES_A_ROUND = 4096
#: The last round is one that takes less than this share off the sequence (of a block of prose, the rest would take 0.2 %).
GAIN = 0.005
MEMO = 1_500_000
END = 0
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """The tokenizers library behind a bounded memo of pretokens: each distinct pretoken is encoded by the library once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            self.special = pretokens.special_string(json.load(f)["added_tokens"])
        self.reset()

    def reset(self) -> None:
        self.index = textkit.HashIndex(1 << 20)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.start, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.known = self.filled = 0

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        got = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(size) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        k, end = self.known, self.known + len(size)
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.start[k:end], self.size[k:end] = self.filled + np.cumsum(size) - size, size
        self.index.put(hashes, np.arange(k, end))
        self.known, self.filled = end, self.filled + len(flat)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a segment's texts and how many each text has."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(texts, np.int64)
        if self.known > MEMO or self.filled > 8 * MEMO:
            self.reset()
        begins, marks = pretokens.boundaries(offsets, data, self.special)
        ends = np.append(begins[1:], len(data))
        if len(marks):  # a special string ends where it ends, even if a pretoken begins there by chance
            ends[np.searchsorted(begins, marks)] = marks + len(self.special)
        hashes = textkit.range_hash(textkit.prefix_hash(data), begins, ends)
        at = self.index.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, where = np.unique(hashes[new], return_index=True)
            raw, where = data.tobytes(), new[where]
            self.learn(distinct, [raw[s:e].decode("utf-8") for s, e in zip(begins[where].tolist(), ends[where].tolist())])
            at[new] = self.index.find(hashes[new])
        size = self.size[at]
        ids = textkit.gather(self.ids, self.start[at], size)
        total = np.concatenate(([0], np.cumsum(size)))
        first = np.searchsorted(begins, offsets)
        return ids, total[first[1:]] - total[first[:-1]]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of a sequence: (sequence, left, right, expansion length)."""
    seq = ids.astype(np.uint32)
    left, right = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    length = np.ones(terminals, np.uint32)
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        inside = (a != END) & (b != END)
        bins = (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(12)
        load = np.bincount(bins[inside], minlength=1 << 20)
        level = np.sort(load[load >= LEAST])
        if not len(level):
            break
        # exact counts of the fullest bins; if pairs that only share a bin fill them, of all bins that can hold a pair
        for least in (int(level[max(0, len(level) - RULES_A_ROUND)]), LEAST):
            near = np.flatnonzero((load >= least)[bins] & inside)
            pairs, inverse, count = np.unique(a[near].astype(np.uint64) << np.uint64(32) | b[near], return_inverse=True, return_counts=True)
            rank = np.argsort(-count, kind="stable")[:RULES_A_ROUND]
            rank = rank[count[rank] >= LEAST]
            if len(rank):
                break
        if not len(rank):
            break
        rule = np.full(len(pairs), -1, np.int64)
        rule[rank] = np.arange(len(rank))
        hit = rule[inverse] >= 0
        at, rule = near[hit], rule[inverse[hit]]
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) > 1
        run = np.flatnonzero(fresh)
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) & 1
        at, rule = at[odd == 0], rule[odd == 0]
        new = pairs[rank]
        x, y = (new >> np.uint64(32)).astype(np.uint32), new.astype(np.uint32)
        seq = seq.copy()
        seq[at] = (terminals + len(left) + rule).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        before, seq = len(seq), seq[keep]
        left, right = np.concatenate([left, x]), np.concatenate([right, y])
        length = np.concatenate([length, length[x] + length[y]])
        if before - len(seq) < GAIN * before:
            break
    return seq, left, right, length[terminals:]


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    """A block of whole documents; ids holds each document's ids with its end id."""
    seq, left, right, length = compress(ids, terminals)
    sizes = np.concatenate([np.ones(terminals, np.int64), length.astype(np.int64)])
    done = np.concatenate(([0], np.cumsum(sizes[seq])))
    start = np.searchsorted(done, np.concatenate(([0], np.cumsum(counts))))
    width = 2 if terminals + len(left) <= 1 << 16 else 4
    head = np.array([len(doc_ids), len(left), terminals, len(seq), width], "<i8")
    parts = [head, doc_ids.astype("<i8"), start.astype("<u4"), counts.astype("<u4"), left.astype("<u4"), right.astype("<u4"), length.astype("<u4"), seq.astype(f"<u{width}")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Block:
    """A block read back; documents decode one by one or all at once."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        docs, rules, self.terminals, n, width = np.frombuffer(blob, "<i8", 5, 8).tolist()
        at = 48
        fields = []
        for kind, size in (("<i8", docs), ("<u4", docs + 1), ("<u4", docs), ("<u4", rules), ("<u4", rules), ("<u4", rules), (f"<u{width}", n)):
            fields.append(np.frombuffer(blob, kind, size, at))
            at += fields[-1].nbytes
        self.doc_ids, self.place, self.counts, left, right, length, self.sequence = fields
        size = np.concatenate([np.ones(self.terminals, np.int64), length.astype(np.int64)])
        start = np.cumsum(size) - size
        arena = np.zeros(int(size.sum()), np.uint32)
        arena[: self.terminals] = np.arange(self.terminals)
        # rules whose parts stand before all of them expand together
        parts, k = np.stack([left, right], 1).astype(np.int64), 0
        last = parts.max(1) if rules else np.zeros(0, np.int64)
        while k < rules:
            ahead = np.flatnonzero(last[k : k + 4096] >= self.terminals + k)
            end = k + int(ahead[0]) if len(ahead) else min(rules, k + 4096)
            pair = parts[k:end].reshape(-1)
            into = int(start[self.terminals + k])
            made = textkit.gather(arena, start[pair], size[pair])
            arena[into : into + len(made)] = made
            k = end
        self.arena, self.start, self.size = arena, start, size

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return textkit.gather(self.arena, self.start[symbols], self.size[symbols])

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from its own part of the sequence."""
        return self.expand(self.sequence[self.place[k] : self.place[k + 1]])

    def all(self) -> np.ndarray:
        return self.expand(self.sequence)


def write_blocks(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Encode texts and write blocks in ascending doc_id order; returns the blocks read back.

    Rows: part (range partition), start (ids before the block in its part), n_ids, block.
    """
    spark = docs.sparkSession
    textkit.on_workers(spark)

    def work(batches):
        from pyspark import TaskContext

        coder, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal before
            keys, counts, ids = (np.concatenate(x) for x in zip(*held))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "start": [before], "n_ids": [len(ids)], "block": pa.array([pack(keys, counts, ids, coder.vocabulary)], pa.binary())})
            before += len(ids)
            held.clear()
            return out

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, offsets, data in textkit.segments(batch.column(1)):
                ids, n = coder.encode(offsets, data)
                ids = np.insert(ids, np.cumsum(n), END).astype(np.uint32)
                held.append((keys[lo:hi], n + 1, ids))
                if sum(len(x[2]) for x in held) >= BLOCK_IDS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select("doc_id", "text").where("doc_id is not null")
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return textkit.saved(sorted_rows.mapInArrow(work, "part int, start long, n_ids long, block binary"), path)


def read_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from written blocks."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, before = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                block = Block(batch.column(2)[k].as_py())
                raw = memoryview(block.all().astype("<u4").tobytes())
                ends = np.cumsum(block.counts, dtype=np.int64)
                starts = ends - block.counts
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(ends), pa.int32()), "doc_id": block.doc_ids, "at": before + starts, "n_tokens": block.counts.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})

    from pyspark.sql import Window

    rows = blocks.select("part", "start", "block").mapInArrow(work, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each partition that wrote
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Encode, write and read back; one row for each row with a doc_id.

    Rows without a doc_id are left out; rows that share one follow each other
    in the order of their texts. Null and empty texts hold the end id alone.
    An empty table gives no rows. Other columns are ignored.
    """
    return read_digests(write_blocks(docs, tokenizer, path))


def op4_repair_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(textkit.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
