"""op13: ranked lexical search over a bit-sliced impact index.

A posting's impact is what a term adds to a document's score, an integer. In a
block of documents (sorted by doc_id, a slot for each) a term has one bitmap
for each bit of its impacts, over those 64-slot words in which it occurs.

1. One scan counts the items' terms in each document and writes the postings.
   Statistics come from what is written.
2. Blocks are made of the postings of BLOCK documents at most, and of POSTINGS
   postings or one document. A slice costs 8 bytes for each bit and word, some
   28 times a posting in plain form unless half of the documents hold the term,
   so postings are what is written, and a block is sliced where it is searched.
3. The scores of a block are bit slices too: the terms of all items are added in
   rounds, one term of each item in a round, by carry arithmetic on the words
   where the term occurs (a repeated term by shifted additions). The best k are
   found from the most significant slice down: while more than k documents are
   left, those without the bit go; where fewer have it, they are in. Equal
   scores are cut by slot, so by doc_id.
4. A block sends at most k documents for each item, and Spark ranks them.

Items are searched in shards of ITEM_BYTES, one scan of the corpus for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit

TOP = 20
BLOCK, POSTINGS = 8192, 500_000
#: Items whose scores are held at once, and bytes of items in a shard.
ITEMS, ITEM_BYTES = 128, 4 << 20
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of the terms: runs of ASCII letters and digits and of all beyond ASCII, lower-cased from A to Z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = textkit.lower(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _TERM[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return textkit.range_hash(textkit.prefix_hash(low), starts, ends), np.searchsorted(offsets, starts, "right") - 1


class Queries:
    """Items as term numbers: `terms` finds a number by hash; plan holds (round, shift, item, term), one addition of impact << shift each."""

    def __init__(self, items: list[tuple[int, str]]):
        offsets, data = textkit.text_buffer(pa.array([t for _, t in items], pa.large_string()))
        hashes, owner = term_hashes(offsets, data)
        distinct, number = np.unique(hashes, return_inverse=True)
        self.ids, self.n_terms = np.array([k for k, _ in items], np.int64), len(distinct)
        self.terms = textkit.HashIndex()
        self.terms.put(distinct, np.arange(len(distinct)))
        pair, repeats = np.unique(owner * max(1, self.n_terms) + number, return_counts=True)
        item, term = pair // max(1, self.n_terms), pair % max(1, self.n_terms)
        plan = [(item[(repeats >> s) & 1 > 0], term[(repeats >> s) & 1 > 0], s) for s in range(int(repeats.max(initial=0)).bit_length())]
        self.item, self.term = np.concatenate([p[0] for p in plan] or [item]), np.concatenate([p[1] for p in plan] or [term])
        self.shift = np.concatenate([np.full(len(p[0]), p[2]) for p in plan] or [item])
        self.repeats = int(np.bincount(owner, minlength=1).max()) if len(owner) else 0

    def rounds(self, first: int):
        """(shift, items from `first`, terms) of each round of ITEMS items; an item is in a round once at most."""
        here = (self.item >= first) & (self.item < first + ITEMS)
        item, term, shift = self.item[here] - first, self.term[here], self.shift[here]
        order = np.lexsort((item, shift))
        item, term, shift = item[order], term[order], shift[order]
        code = shift * ITEMS + item
        turn = np.arange(len(code)) - np.searchsorted(code, code, "left")
        for s, t in sorted(set(zip(shift.tolist(), turn.tolist()))):
            mine = (shift == s) & (turn == t)
            yield s, item[mine], term[mine]


class Block:
    """The bit-sliced impacts of a block's postings: (term, slot, impact), sorted by term and slot."""

    def __init__(self, term: np.ndarray, slot: np.ndarray, impact: np.ndarray, slots: int):
        self.width = -(-slots // 64)
        code = term * self.width + (slot >> 6)
        first = np.flatnonzero(np.concatenate((code[:1] >= 0, code[1:] != code[:-1])))
        self.word, self.cell_term = code[first] % self.width, code[first] // self.width
        bit = np.uint64(1) << (slot & 63).astype(np.uint64)
        self.slices = np.stack([np.add.reduceat(np.where((impact >> k) & 1, bit, np.uint64(0)), first) for k in range(int(impact.max(initial=0)).bit_length())]) if len(first) else np.zeros((0, 0), np.uint64)

    def scores(self, queries: Queries, first: int, n_items: int, bits: int) -> np.ndarray:
        """Bit slices of the scores of n_items items from `first`: [bit, item * width + word]."""
        total = np.zeros((bits, n_items * self.width), np.uint64)
        for shift, item, term in queries.rounds(first):
            lo, hi = np.searchsorted(self.cell_term, term, "left"), np.searchsorted(self.cell_term, term, "right")
            cells = textkit.gather(np.arange(len(self.word)), lo, hi - lo)
            if not len(cells):
                continue
            at, carry = np.repeat(item, hi - lo) * self.width + self.word[cells], np.zeros(len(cells), np.uint64)
            for k in range(shift, bits):
                old = total[k, at]
                if k - shift < len(self.slices):
                    new = self.slices[k - shift, cells]
                    either = old ^ new
                    total[k, at], carry = either ^ carry, (old & new) | (carry & either)
                elif carry.any():
                    total[k, at], carry = old ^ carry, old & carry
                else:
                    break
        return total


def best_slots(total: np.ndarray, n_items: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, slot, score) of the k highest scores above 0 of each item, equal ones by slot."""
    total = total.reshape(len(total), n_items, -1)
    chosen, open_ = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    for slice_ in total[::-1]:
        more = chosen | (open_ & slice_)
        n = np.bitwise_count(more).sum(axis=1, dtype=np.int64)[:, None]
        chosen, open_ = np.where(n <= k, more, chosen), np.where(n > k, open_ & slice_, np.where(n < k, open_ & ~slice_, np.uint64(0)))

    def slots(bits):
        item, at = np.nonzero(np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little"))
        return item, at

    item, slot = slots(chosen)
    room = k - np.bincount(item, minlength=n_items)
    tied_item, tied = slots(open_)
    fits = np.arange(len(tied)) - np.searchsorted(tied_item, tied_item, "left") < room[tied_item]
    item, slot = np.concatenate([item, tied_item[fits]]), np.concatenate([slot, tied[fits]])
    score = np.zeros(len(item), np.int64)
    for b, slice_ in enumerate(total):
        score += ((slice_[item, slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
    return item, slot, score


def postings_of(shared):
    def work(batches):
        queries = shared.value
        for batch in batches:
            for lo, hi, offsets, data in textkit.segments(batch.column(1)):
                hashes, docs = term_hashes(offsets, data)
                n = np.bincount(docs, minlength=hi - lo)
                term = queries.terms.find(hashes) if queries.n_terms else np.full(len(hashes), -1)
                code, tf = np.unique(docs[term >= 0] * max(1, queries.n_terms) + term[term >= 0], return_counts=True)
                some = np.flatnonzero(n)
                ends = np.searchsorted(code // max(1, queries.n_terms), some, "right")
                cuts = pa.array(np.concatenate(([0], ends)), pa.int32())  # documents without terms have no postings
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some], pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(code % max(1, queries.n_terms), pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32()))],
                    ["doc_id", "n", "terms", "tf"],
                )

    return work


def search_blocks(shared, weights, n_docs: int, n_terms: int, k: int):
    def block(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        table = table.sort_by("doc_id").combine_chunks()
        lists = table["terms"].chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        term, tf = lists.flatten().to_numpy().astype(np.int64), table["tf"].chunk(0).flatten().to_numpy().astype(np.int64)
        slot = np.repeat(np.arange(len(size)), size)
        m = 75 + 25 * table["n"].to_numpy() * n_docs // n_terms
        order = np.lexsort((slot, term))
        term, slot, tf = term[order], slot[order], tf[order]
        return table["doc_id"].to_numpy(), Block(term, slot, weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[slot])), len(size))

    def answers(parts):
        queries = shared.value
        ids, sliced = block(parts)
        bits = max(1, (int(weights.value.max(initial=0)) * 1_000_000 * queries.repeats).bit_length())
        for first in range(0, len(queries.ids), ITEMS):
            n_items = min(ITEMS, len(queries.ids) - first)
            item, slot, score = best_slots(sliced.scores(queries, first, n_items, bits), n_items, k)
            yield pa.RecordBatch.from_arrays([pa.array(queries.ids[first + item]), pa.array(ids[slot]), pa.array(score)], ["item_id", "doc_id", "score"])

    def work(batches):
        held, docs, postings = [], 0, 0
        for whole in batches:
            ends = np.concatenate(([0], np.cumsum(np.diff(whole.column("terms").offsets.to_numpy()))))
            lo = 0
            while lo < whole.num_rows:
                room = int(np.searchsorted(ends, ends[lo] + POSTINGS - postings, "right")) - 1
                hi = min(whole.num_rows, max(room, lo + (not held)), lo + BLOCK - docs)
                if hi > lo:
                    held.append(whole.slice(lo, hi - lo))
                    docs, postings = docs + hi - lo, postings + int(ends[hi] - ends[lo])
                if hi < whole.num_rows:  # the block is full
                    yield from answers(held)
                    held, docs, postings = [], 0, 0
                lo = hi
        if held:
            yield from answers(held)

    return work


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item, equal scores by doc_id.

    Documents without a doc_id and items without an item_id are left out; an
    item_id with several texts has the smallest of them, so repeated items
    count once. Documents without terms (null and empty texts) are no part of
    the statistics. Rows that share a doc_id are documents of their own. Empty
    tables, and items that no document meets, give no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    textkit.on_workers(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items = items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")).where("text is not null")
    shards = -(-(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // ITEM_BYTES)
    out = None
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).orderBy("item_id").collect()  # ITEM_BYTES on average
        if rows:
            part = search_shard(docs, Queries([(r[0], r[1]) for r in rows]), k)
            out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_shard(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    rows = textkit.saved(docs.mapInArrow(postings_of(shared), "doc_id long, n long, terms array<int>, tf array<int>"))
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(queries.n_terms, np.int64)
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.count("*") + 1)))
    for term, w in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(weight).collect():  # terms of a shard
        weights[term] = w
    return rows.mapInArrow(search_blocks(shared, spark.sparkContext.broadcast(weights), n_docs, n_terms or 1, k), "item_id long, doc_id long, score long")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(textkit.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = f"""
with docs as (select row_number() over () as r, doc_id, text from documents where doc_id is not null),
terms as (select r, doc_id, {_SPLIT} as term from docs),
tf as (select r, doc_id, term, count(*) as tf from terms group by r, doc_id, term),
len as (select r, count(*) as n from terms group by r),
corpus as (select count(*) as n_docs, sum(n)::bigint as n_terms from len),
df as (select term, count(*) as df from tf group by term),
weights as (select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2 * df + 1)))::bigint as w from df, corpus),
items as (select item_id, min(text) as text from benchmark where item_id is not null group by item_id),
asked as (select item_id, {_SPLIT} as term from items),
wanted as (select item_id, term, count(*) as repeats from asked group by item_id, term),
scores as (select item_id, tf.r, tf.doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from wanted join tf using (term) join weights using (term) join len on tf.r = len.r, corpus group by item_id, tf.r, tf.doc_id),
ranks as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
select * from ranks where rank <= 20
"""
