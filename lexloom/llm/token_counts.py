"""op7: token counts by a compiled finite-state tokenizer.

Two deterministic transducers in a row. The first (pretokens.py) marks where
pretokens begin; its chunk maps compose by a parallel prefix scan. The second
reads (byte, begins) symbols and emits, on each transition, how many tokens
the byte-level BPE of the pretoken read so far gains or loses by that byte;
the sum over a text is its token count, without building tokens.

The second machine follows from two facts. The last token of a BPE of w is
the one vocabulary token t that ends w and is compatible with the last token
of the BPE of w without t (a pair is compatible if BPE leaves it as it is),
and later steps only need the last tokens at positions where some vocabulary
token may have begun. A state is therefore the longest suffix of the pretoken
that begins a vocabulary token, with the last token and relative count at each
such position. States are determinised on demand, as in lazily built regular
expression machines; the table is bounded and dropped when full, so memory is
bounded for any text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretokens, textkit

LANE = 512
MAX_STATES = 250_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_machines: dict[str, "CountMachine"] = {}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE and the bytes they stand for (its published rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class CountMachine:
    """The counting transducer of one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand = byte_alphabet()
        as_bytes = lambda s: bytes(stand[c] for c in s)
        self.special = pretokens.special_string(spec["added_tokens"])
        special = {self.special.decode()}
        self.tokens = {as_bytes(t) for t in spec["model"]["vocab"] if t not in special}
        self.rank = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[as_bytes(a), as_bytes(b)] = k
        self.begins = {t[:n] for t in self.tokens for n in range(len(t) + 1)}
        self.parts = {a + b: (a, b, k) for (a, b), k in sorted(self.rank.items(), key=lambda x: -x[1])}  # the first merge that makes a token
        self.longer: dict[bytes, list[bytes]] = {}
        for t in self.tokens:
            for n in range(1, len(t)):
                self.longer.setdefault(t[:n], []).append(t)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; cells of the open-addressing transition table hold (state << 8 | byte) + 1, or 0."""
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.used = 0
        self.table(1 << 16)
        self.state(b"", ((0, b"", 0),))

    def table(self, size: int) -> None:
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.cell = np.zeros(size, np.int64)
        self.value = np.zeros(size, np.int64)  # next state << 8 | gain + 128

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert new distinct keys."""
        self.used += len(keys)
        if self.used * 2 > len(self.cell):
            old = self.cell > 0
            keys, values = np.concatenate([self.cell[old], keys]), np.concatenate([self.value[old], values])
            self.table(1 << int(4 * self.used).bit_length())
        slot = (keys.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        while len(keys):
            free = self.cell[slot] == 0
            self.cell[slot[free]] = keys[free]
            done = self.cell[slot] == keys
            self.value[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & (len(self.cell) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 where there is none."""
        slot = (keys.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        cell, out = self.cell[slot], self.value[slot]
        wrong = np.flatnonzero(cell != keys)
        while len(wrong):
            empty = cell[wrong] == 0
            out[wrong[empty]] = -1
            wrong = wrong[~empty]
            slot[wrong] = (slot[wrong] + 1) & (len(self.cell) - 1)
            cell[wrong] = self.cell[slot[wrong]]
            hit = cell[wrong] == keys[wrong]
            out[wrong[hit]] = self.value[slot[wrong[hit]]]
            wrong = wrong[~hit]
        return out

    def state(self, suffix: bytes, past: tuple) -> int:
        key = (suffix, past)
        k = self.ids.get(key)
        if k is None:
            k = self.ids[key] = len(self.states)
            self.states.append(key)
        return k

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether BPE of a + b is [a, b]: undo the merges of both, latest first, and look for an earlier merge across the border."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            whole = (None, None, -1)
            limit, known = 1 << 30, None
            while known is None:
                across = self.rank.get((a, b))
                left, right = self.parts.get(a, whole), self.parts.get(b, whole)
                if across is not None and across < limit:
                    known = False
                elif left[2] < 0 and right[2] < 0:
                    known = True
                elif left[2] > right[2]:
                    a, limit = left[1], left[2]
                else:
                    b, limit = right[0], right[2] + 1
            self.pairs[key] = known
        return known

    def alive(self, d: int, last: bytes, part: bytes) -> bool:
        """Whether some token may yet begin d bytes ago, where it would begin with `part`."""
        if not d:
            return True
        longer = self.longer.get(part, ())
        return len(longer) > 24 or not last and bool(longer) or any(self.compatible(last, t) for t in longer)

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE of a short byte string."""
        parts = [word[k : k + 1] for k in range(len(word))]
        rank = self.rank
        while len(parts) > 1:
            best, at = min((rank.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def expand(self, k: int, byte: int) -> int:
        """Determinise one transition: its table value."""
        suffix, past = self.states[k]
        word = suffix + bytes([byte])
        for d, before, c in past:  # longest first; before: the last token and c: the count of the part that ends d bytes ago
            t = word[len(word) - d - 1 :]
            if t in self.tokens and (not before or self.compatible(before, t)):
                gain = c + 1
                break
        now = [(d + 1, before, c - gain) for d, before, c in past if word[len(word) - d - 1 :] in self.begins and self.alive(d + 1, before, word[len(word) - d - 1 :])]
        now.append((0, t, 0))
        n = now[0][0]
        return self.state(word[len(word) - n :], tuple(now)) << 8 | gain + 128

    def gains(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens gained at each byte; begins: sorted positions where pretokens begin, the first at 0."""
        n = len(data)
        if len(self.states) > MAX_STATES or len(self.pairs) > 4 * MAX_STATES:
            self.pairs = {}
            self.reset()
        fresh = np.full(n, -1, np.int64)
        fresh[begins] = 0
        cuts = np.unique(begins[np.searchsorted(begins, np.arange(0, n, LANE)).clip(max=len(begins) - 1)])
        ends = np.append(cuts[1:], n)
        order = np.argsort(cuts - ends, kind="stable")  # long lanes first: the lanes still at work are a prefix
        starts, left = cuts[order], (ends - cuts)[order]
        out = np.zeros(n, np.int8)
        state = np.zeros(len(starts), np.int64)
        active = np.searchsorted(-left, -np.arange(int(left[0])), "left")
        for step, m in enumerate(active.tolist()):
            at = starts[:m] + step
            keys = ((state[:m] & fresh[at]) << 8 | data[at]) + 1
            to = self.find(keys)
            if (to < 0).any():
                new = np.unique(keys[to < 0])
                self.put(new, np.array([self.expand(int(x) - 1 >> 8, int(x) - 1 & 255) for x in new], np.int64))
                to = self.find(keys)
            out[at] = (to & 255) - 128
            state[:m] = to >> 8
        return out

    def count(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Tokens of each text of a segment."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        begins, marks = pretokens.boundaries(offsets, data, self.special)
        gains = self.gains(data, begins)
        for p in marks:
            gains[p : p + len(self.special)] = 0
            gains[p] = 1
        total = np.concatenate(([0], np.cumsum(gains, dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]


def machine(path: str) -> CountMachine:
    if path not in _machines:
        _machines[path] = CountMachine(path)
    return _machines[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Token counts of each text under a byte-level BPE file.

    One row for each row with a doc_id (rows without one are no documents and
    are left out; repeated rows are counted each). Null and empty texts have 0
    bytes and 0 tokens. Other columns are ignored, whatever their names. The
    stage is a map over partitions: no shuffle, bounded memory.
    """
    textkit.on_workers(docs.sparkSession)

    def work(batches):
        counter = machine(tokenizer)
        for batch in batches:
            for lo, hi, offsets, data in textkit.segments(batch.column(1)):
                n = counter.count(offsets, data)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(work, SCHEMA)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(textkit.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
