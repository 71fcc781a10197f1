"""op11: mixing sources to target weights by a min-cost flow.

Sources overlap where they hold the same text. Documents are aggregated by the
set of sources that hold their text (their pattern); the flow routes words
from patterns to sources, and each source has a quota.

1. A source's target is its share of all words by weight; no target is above
   MOST times the words of its source, and what is cut off is shared anew by
   weight. Quotas are targets in whole words.
2. An arc from a pattern to a source carries MOST times the words of their
   documents at most. Reading a pattern's distinct words for the k-th time costs
   k a word, whichever sources they are read for: a convex cost, so cheap
   readings come first. The flow is built by cost: all arcs of a reading are
   opened at once, sources fill up from what is free, and a source that finds
   nothing free takes over words from another source that can be served by
   a third pattern, along the shortest such path.
3. The words of an arc are spread over its documents: each is read as often as
   all can be, and the rest goes to documents in the order of a seeded hash of
   their text and doc_id, up to the one where the words are used up, which is
   read in part. The cut is found from the sums of 256 parts of the hashes, then
   of 256 parts of that part, and so on; only the last part's documents are sorted.

The network has one row for each pattern of several sources, CELLS cells
(patterns by sources) at most on the driver. Beyond that the patterns with the
fewest words are split into their sources, which are routed as they are: no
document and no word is lost, but repeated readings of such a text for several
sources are not seen as repeated.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3, 0
#: Patterns times sources on the driver; each cell makes one row of 48 bytes at most that is broadcast.
CELLS = 500_000
#: Readings that are told apart by cost.
READINGS = 64
#: A cut is found from sums over 256 parts, so many times in turn.
LEVELS = 3


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size; the excess goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
        open_ = [k for k in open_ if k not in set(over)]
        left = float(sum(sizes)) - sum(out)
    return out


def routed(quota: np.ndarray, own_words: np.ndarray, own_room: np.ndarray, words: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flow of least cost that fills the quotas: (words that each source reads of its own pattern, [pattern, source] words of the shared ones).

    own_words and words are a pattern's distinct words, own_room and room the
    most that an arc carries. A pattern's k-th reading costs k a word, and one
    cost holds beyond READINGS of them.
    """
    need, own, flow = quota.copy(), np.zeros_like(own_words), np.zeros_like(room)
    read = 0
    while need.any():
        read += 1
        whole = read > READINGS
        own_free = np.minimum(own_room - own, own_room if whole else np.maximum(read * own_words - own, 0))
        take = np.minimum(own_free, need)
        own += take
        need -= take
        free = room.sum(axis=1) if whole else np.maximum(read * words - flow.sum(axis=1), 0)
        own_free -= take
        for s in np.flatnonzero(need):
            _fill(flow, free, room, need, s)
        for s in np.flatnonzero(need):
            while need[s] and _shift(flow, free, room, need, own, own_free, s):
                pass
        if whole and need.any():
            raise ValueError("the quotas are beyond what the sources hold")
    return own, flow


def _spread(room: np.ndarray, amount: int) -> np.ndarray:
    """Take `amount` from the front of room."""
    return np.clip(amount - (np.cumsum(room) - room), 0, room)


def _fill(flow, free, room, need, s) -> None:
    got = _spread(np.minimum(free, room[:, s] - flow[:, s]), int(need[s]))
    flow[:, s] += got
    free -= got
    need[s] -= int(got.sum())


def _shift(flow, free, room, need, own, own_free, s) -> bool:
    """Serve source s by words that pass from source to source, the last of which has something free; False if there is no such path."""
    came, todo = {s: -1}, deque([s])
    while todo:
        t = todo.popleft()
        spare = int(np.minimum(free, room[:, t] - flow[:, t]).sum()) + int(own_free[t])
        if spare and t != s:
            path = [t]
            while came[path[-1]] >= 0:
                path.append(came[path[-1]])
            path = path[::-1]  # s first
            hops = list(zip(path, path[1:]))
            amount = min([int(need[s]), spare, *(int(np.minimum(flow[:, b], room[:, a] - flow[:, a]).sum()) for a, b in hops)])
            for a, b in hops:
                got = _spread(np.minimum(flow[:, b], room[:, a] - flow[:, a]), amount)
                flow[:, a] += got
                flow[:, b] -= got
            mine = min(amount, int(own_free[t]))
            own[t] += mine
            own_free[t] -= mine
            got = _spread(np.minimum(free, room[:, t] - flow[:, t]), amount - mine)
            flow[:, t] += got
            free -= got
            need[s] -= mine + int(got.sum())
            return amount > 0
        gives = np.minimum(flow, (room[:, t] - flow[:, t])[:, None]).sum(axis=0)
        for u in np.flatnonzero(gives):
            if int(u) not in came:
                came[int(u)] = t
                todo.append(int(u))
    return False


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cuts(rows: DataFrame, arcs: DataFrame) -> DataFrame:
    """rows (arc, hash, size, ...) with `got`: the part of the arc's `rest` words that falls on a row, in the order of hashes."""
    parts = [F.shiftrightunsigned("hash", 64 - 8 * k).cast("long") for k in range(1, LEVELS + 1)]  # the hash's first bytes
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside, marks = rows.where("size > 0"), textkit.saved(arcs.where("rest > 0").select("arc", "rest"))
    for part in parts:
        # the part in which the rest ends, and what is left of it there
        sums = inside.groupBy("arc", part.alias("part")).agg(F.sum("size").alias("words")).join(F.broadcast(marks), "arc")
        run = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        marks = textkit.saved(run.where("before < rest and before + words >= rest").select("arc", F.col("part").alias("cut"), (F.col("rest") - F.col("before")).alias("rest")))
        inside = rows.where("size > 0").join(F.broadcast(marks.select("arc", "cut")), "arc").where(part == F.col("cut")).drop("cut")
    placed = rows.join(F.broadcast(marks.withColumnRenamed("rest", "left")), "arc", "left")
    here = F.coalesce((parts[-1] == F.col("cut")) & (F.col("size") > 0), F.lit(False))
    whole = placed.where(~here).withColumn("got", F.when(parts[-1] < F.col("cut"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    order = Window.partitionBy("arc").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where(here).withColumn("got", F.greatest(F.lit(0), F.least("size", F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0)))).cast("long"))
    return whole.unionByName(cut).drop("cut", "left")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row: the words that a mix takes of it, repeats counted.

    Sources in code point order, null last, have the weights in turn. Each
    source's taken words are its target, rounded; a row is taken `most` times at
    most, in whole but for one row of each pattern and source. Rows without a doc_id
    are left out; rows without words take none; rows that share a doc_id are
    documents of their own. Equal rows share what falls on them in any order.
    An empty table gives no rows. Texts are told apart by 64-bit hashes. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = textkit.saved(docs.where("doc_id is not null").select("doc_id", "source", F.xxhash64(text).alias("text_key"), words_of(F.col("text")).alias("size")))
    names = sorted(((r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()), key=lambda x: (x[0] is None, x[0] or ""))  # one row for each source
    sizes = [n for _, n in names]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], most)
    listed = spark.createDataFrame([(k, s, n, g) for k, ((s, n), g) in enumerate(zip(names, goal))], "number int, source string, source_size long, target double")
    numbered = textkit.saved(rows.join(F.broadcast(listed.select("number", F.col("source").alias("name"))), F.col("source").eqNullSafe(F.col("name"))).drop("name"))
    textkit.discard(rows)
    # one row for each text and source, made before the shuffle where copies meet in a task
    held = numbered.where("size > 0").groupBy("text_key", "number").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
    texts = textkit.saved(held.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("number", "words"))).alias("held"), F.max("size").alias("size")))
    shape = F.transform("held", lambda x: x["number"])
    totals = texts.groupBy(shape.alias("pattern")).agg(F.sum("size").alias("distinct"), F.sum(F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + x["words"])).alias("words"))
    shared = totals.where(F.size("pattern") > 1).orderBy(F.desc("words"), "pattern").limit(max(1, CELLS // max(1, len(names)))).collect()
    known = {tuple(r.pattern): k for k, r in enumerate(shared)}
    table = spark.createDataFrame([(list(p), k) for p, k in known.items()], "pattern array<int>, row int")
    with_row = texts.withColumn("pattern", shape).join(F.broadcast(table), "pattern", "left").where("row is not null")
    room, own_room = np.zeros((len(shared), len(names)), np.int64), most * np.array(sizes, np.int64)
    for row, number, words in with_row.select("row", F.explode("held").alias("x")).groupBy("row", "x.number").agg(F.sum("x.words")).collect():  # CELLS at most
        room[row, number] = most * words
        own_room[number] -= most * words
    own_words = np.zeros(len(names), np.int64)
    split = texts.withColumn("pattern", shape).join(F.broadcast(table), "pattern", "left_anti")
    for number, words in split.select("size", F.explode("held").alias("x")).groupBy("x.number").agg(F.sum("size")).collect():  # one row for each source
        own_words[number] = words
    quota = np.minimum(np.floor(np.array(goal) + 0.5).astype(np.int64), most * np.array(sizes, np.int64)) if names else np.zeros(0, np.int64)
    own, flow = routed(quota, own_words, own_room, np.array([r.distinct for r in shared], np.int64), room)

    arcs = [(-1 - s, int(own[s]) // (int(own_room[s]) // most), int(own[s]) % (int(own_room[s]) // most)) for s in range(len(names)) if own_room[s]]
    arcs += [(int(p) * len(names) + int(s), int(flow[p, s]) // (int(room[p, s]) // most), int(flow[p, s]) % (int(room[p, s]) // most)) for p, s in zip(*np.nonzero(room))]
    arcs = spark.createDataFrame(arcs, "arc long, times long, rest long")
    keys = textkit.sized(textkit.saved(with_row.select("text_key", "row")), 16)
    own_arc = (-1 - F.col("number")).cast("long")
    placed = numbered.join(keys, "text_key", "left").withColumn("arc", F.when(F.col("size") > 0, F.coalesce(F.col("row").cast("long") * len(names) + F.col("number"), own_arc)).otherwise(own_arc))
    hashed = textkit.saved(placed.select("doc_id", "number", "size", "arc", F.xxhash64(F.lit(seed), "text_key", "doc_id").alias("hash")))
    textkit.discard(texts, numbered)
    taken = cuts(hashed, arcs).join(F.broadcast(arcs.select("arc", "times")), "arc", "left")
    return taken.join(F.broadcast(listed), "number").select("doc_id", "source", "size", "source_size", "target", (F.coalesce("times", F.lit(0)) * F.col("size") + F.col("got")).cast("long").alias("taken"))


def op11_source_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(textkit.documents(spark, sf_dir))
