"""op1: benchmark decontamination by BM25 with block-max WAND.

The index holds the test items; every passage of the corpus (PASSAGE words,
every PASSAGE / 2 words) is a query. An item is retrieved if its BM25 score
reaches its threshold: SHARE of the score of the item against itself, and for
items of more than 3/4 of a passage's words that share of what so many words
score on average, as a passage can't hold more of them; impacts are stored
divided by the item's threshold, so one threshold, 1, holds for all. Passages are first bounded together: an item's frequent terms alone
can't reach its threshold, so a passage needs enough of its rare terms, and
only such passages are evaluated, by block-max WAND. A retrieved item counts
as leaked if the passages hold enough of both its question and its answer, as
shares of their GRAM-word sequences; an item whose question or answer is
shorter than that must be held whole, as one sequence of its own length or as
GRAM-word sequences.

The items are searched in shards of INDEX_BYTES, one scan of the corpus for
each; a worker builds a shard's index once.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

PASSAGE, SHARE, OVERLAP, GRAM = 64, 0.5, 0.5, 3
K1, B = 1.2, 0.75
BLOCK = 16
#: Bytes of items in one index; more items are searched in several passes.
INDEX_BYTES = 16 << 20
_built: dict[str, "Index"] = {}


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence; an item without two sentences of four words is cut in the middle."""
    parts = re.split(r"(?<=[.!?])\s+|\n+", text.strip())
    q, a = " ".join(parts[:-1]), parts[-1]
    if min(len(q.split()), len(a.split())) < 4:
        words = text.split()
        q, a = " ".join(words[: -(-len(words) // 2)]), " ".join(words[-(-len(words) // 2) :])
    return q, a


def word_hashes(text: str) -> np.ndarray:
    offsets, data = textkit.text_buffer(pc.utf8_lower(pa.array([text])))
    starts, ends, _ = textkit.word_spans(offsets, data)
    return textkit.range_hash(textkit.prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def item_grams(text: str) -> tuple[int, list[np.ndarray]]:
    """(n, [n-grams of the question, of the answer]); both are the whole item's where either has fewer than GRAM words."""
    parts = [word_hashes(p) for p in question_and_answer(text)]
    if min(map(len, parts)) < GRAM:
        parts = [word_hashes(text)] * 2
    n = min(GRAM, len(parts[0]))
    return n, [np.unique(textkit.gram_hash(p, n)) for p in parts]


class Index:
    """An inverted index of items: impact-normalised postings in blocks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [k for k, _ in items]
        words = [word_hashes(t) for _, t in items]
        self.parts = [item_grams(t) for _, t in items]
        lengths = np.array([len(w) for w in words], np.float64)
        mean = lengths.mean()
        counts = [np.unique(w, return_counts=True) for w in words]
        terms, df = np.unique(np.concatenate([u for u, _ in counts]), return_counts=True)
        self.terms = textkit.HashIndex()
        self.terms.put(terms, np.arange(len(terms)))
        idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
        postings: list[list[tuple[int, float]]] = [[] for _ in terms]
        scale = []
        for k, (u, tf) in enumerate(counts):
            t = np.searchsorted(terms, u)
            impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[k] / mean))
            threshold = SHARE * impact.sum() * min(1.0, 0.75 * PASSAGE / lengths[k])
            scale.append(threshold)
            for x, y in zip(t.tolist(), (impact / threshold).tolist()):
                postings[x].append((k, y))
        self.threshold = np.array(scale)
        self.items = [np.array([k for k, _ in p]) for p in postings]
        self.impacts = [np.array([y for _, y in p]) for p in postings]
        self.most = np.array([y.max() for y in self.impacts])
        self.block_last = [k[np.minimum(np.arange(BLOCK - 1, len(k) + BLOCK - 1, BLOCK), len(k) - 1)] for k in self.items]
        self.block_most = [np.maximum.reduceat(y, np.arange(0, len(y), BLOCK)) for y in self.impacts]
        # frequent terms that together reach no item's threshold
        self.rest = np.zeros(len(items))
        self.rare = np.ones(len(terms), bool)
        for t in np.argsort(-df, kind="stable").tolist():
            if (self.rest[self.items[t]] + self.impacts[t] < 0.6).all():
                self.rest[self.items[t]] += self.impacts[t]
                self.rare[t] = False
        size = np.where(self.rare, [len(k) for k in self.items], 0)
        self.size, self.start = size, np.cumsum(size) - size
        kept = np.flatnonzero(self.rare).tolist()
        self.flat_items = np.concatenate([self.items[t] for t in kept] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.flat_impacts = np.concatenate([self.impacts[t] for t in kept] or [np.zeros(0)])

    def search(self, query: np.ndarray) -> dict[int, float]:
        """Block-max WAND: all items whose score reaches 1, exactly."""
        lists = [[int(self.items[t][0]), 0, int(t)] for t in np.unique(query)]
        found: dict[int, float] = {}
        while lists:
            lists.sort()
            total, pivot = 0.0, None
            for k, (item, _, t) in enumerate(lists):
                total += self.most[t]
                if total >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                break
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            bound, border = 0.0, None
            for item, at, t in lists[: pivot + 1]:
                block = int(np.searchsorted(self.block_last[t], target))
                if block < len(self.block_last[t]):
                    bound += self.block_most[t][block]
                    last = int(self.block_last[t][block])
                    border = last if border is None else min(border, last)
            if bound < 1 - 1e-9:  # no item up to the nearest block border can reach the threshold
                target = (border if border is not None else target) + 1
                if pivot + 1 < len(lists):
                    target = min(target, lists[pivot + 1][0])
            elif lists[0][0] == target:
                score = 0.0
                for item, at, t in lists[: pivot + 1]:
                    score += float(self.impacts[t][at])
                if score >= 1 - 1e-9:
                    found[target] = score
                target += 1
            moved = []
            for k, (item, at, t) in enumerate(lists):
                if k <= pivot and item < target:
                    at = int(np.searchsorted(self.items[t], target))
                    if at == len(self.items[t]):
                        continue
                    item = int(self.items[t][at])
                moved.append([item, at, t])
            lists = moved
        return found


def passages_worth_searching(index: Index, terms: np.ndarray, docs: np.ndarray, position: np.ndarray) -> list[tuple[int, int]]:
    """(document, half passage) pairs whose passage may reach some item's threshold.

    terms: indexed term of each word or -1; position: of the word in its document.
    """
    half = PASSAGE // 2
    use = np.flatnonzero(terms >= 0)
    use = use[index.size[terms[use]] > 0]
    if not len(use):
        return []
    t = terms[use]
    n = index.size[t]
    items = textkit.gather(index.flat_items, index.start[t], n)
    impacts = textkit.gather(index.flat_impacts, index.start[t], n)
    width = int(position.max()) // half + 3
    slot = np.repeat(docs[use] * width + position[use] // half + 1, n)  # a free slot before each document
    code, inverse = np.unique(slot * len(index.ids) + items, return_inverse=True)
    score = np.bincount(inverse, impacts)
    item, slot = code % len(index.ids), code // len(index.ids)
    need = 1 - index.rest[item] - 1e-9
    out = set()
    after = np.searchsorted(code, code + len(index.ids))
    hit = (after < len(code)) & (code[np.minimum(after, len(code) - 1)] == code + len(index.ids))
    pair = score + np.where(hit, score[np.minimum(after, len(code) - 1)], 0.0)
    for s in slot[pair >= need].tolist():  # this half and the next
        out.add(s)
    before = np.searchsorted(code, code - len(index.ids))
    alone = ~((before < len(code)) & (code[np.minimum(before, len(code) - 1)] == code - len(index.ids)))
    for s in slot[alone & (score >= need)].tolist():  # the half before, which has none of the item's rare terms, and this one
        out.add(s - 1)
    return sorted((s // width, s % width - 1) for s in out)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) pairs where a document holds a test item: with n_passages, bm25, question_overlap, answer_overlap.

    Documents without a doc_id, and items without an id or without words, are
    left out; null and empty texts hold nothing; rows that share a doc_id give
    a row for each; items that share an id are items of their own, and equal
    rows of the benchmark one; an empty benchmark gives no rows. An item of one
    word is held by every document with that word. Other columns are ignored.
    """
    spark = docs.sparkSession
    textkit.on_workers(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items = items.select("item_id", "text").where("item_id is not null and text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // INDEX_BYTES)
    schema = "doc_id long, item_id long, n_passages long, bm25 double, question_overlap double, answer_overlap double"
    out = None
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).orderBy("item_id", "text").collect()  # INDEX_BYTES on average
        if rows:
            shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r[0], r[1]) for r in rows]))
            part = docs.mapInArrow(search_with(shared), schema)
            out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def built(shared) -> Index:
    """The index of a shard, built once in a worker; only the last one stays."""
    name, items = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Index(items)
    return _built[name]


def search_with(shared):
    def work(batches):
        index, half = built(shared), PASSAGE // 2
        for batch in batches:
            for lo, hi, offsets, low in textkit.segments(pc.utf8_lower(batch.column(1))):
                starts, ends, docs = textkit.word_spans(offsets, low)
                if not len(starts):
                    continue
                hashes = textkit.range_hash(textkit.prefix_hash(low), starts, ends)
                terms = index.terms.find(hashes)
                first = np.searchsorted(docs, np.arange(hi - lo + 1))
                position = np.arange(len(docs)) - first[docs]
                found: dict[tuple[int, int], list] = {}
                for d, h in passages_worth_searching(index, terms, docs, position):
                    a = first[d] + max(0, h) * half
                    b = min(first[d] + (h + 2) * half, first[d + 1])
                    query = terms[a:b]
                    for item, score in index.search(query[query >= 0]).items():
                        x = found.setdefault((d, item), [0, 0.0, a, b])
                        x[0], x[1], x[3] = x[0] + 1, max(x[1], score * index.threshold[item]), b
                        x.append(hashes[max(first[d], a - half) : min(first[d + 1], b + half)])
                out = []
                for (d, item), x in found.items():
                    size, parts = index.parts[item]
                    near = np.concatenate([textkit.gram_hash(w, size) for w in x[4:]])
                    q, answer = (float(np.isin(p, near).mean()) for p in parts)
                    if q >= OVERLAP and answer >= OVERLAP:
                        out.append((d, index.ids[item], x[0], x[1], q, answer))
                if out:
                    rows, *rest = zip(*out)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)), *(pa.array(list(c)) for c in rest)], ["doc_id", "item_id", "n_passages", "bm25", "question_overlap", "answer_overlap"])

    return work


def op1_bm25_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(textkit.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
