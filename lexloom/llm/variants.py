"""op12: spelling variants by a self-join of the vocabulary trie with active-node sets.

Words of a text are maximal runs of Latin letters. The vocabulary holds the
runs met often enough; two words are near if one code point is inserted,
deleted or replaced between them.

1. Runs are found and counted over byte buffers; Spark sums the counts.
2. The trie is dealt by prefixes. Take a pair whose shorter word has m code
   points and whose first difference is at position l. For any window [a, b) of
   positions that holds l, both words have the same first a and the same last
   m - b code points. So the windows [0, p) and [p, m + 1), p = (m + 1) div 2,
   find each pair once: the second one in the subtrie of a prefix, the first
   one below a common ending. A subtrie of more than GROUP words is dealt again by
   the two halves of its window, until none is larger (a window of one position
   leaves no more words than there are letters).
3. Many subtries go through a task at once, level by level, as arrays. The
   active nodes of a node are those at distance one from it: of its own depth
   (one code point replaced) or one deeper (one inserted); at distance zero is
   the node alone. A child's active nodes are its siblings, its own children and
   the active nodes of its parent that go on with the same code point. Nodes
   with a single word and no active node are left. Pairs at which a word ends
   on both sides are near; a task sends for each word their number and the best.
4. A word's form is its near word with the largest count, if that is FACTOR
   times its own or more; forms are followed by doubling. Counts double with each
   step, so the rounds are few.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

MIN_CHARS, MIN_COUNT, FACTOR = 5, 3, 2
#: Most words of a subtrie before it is dealt again, and words that a task gets about.
GROUP, ROWS = 20_000, 100_000
#: Longest run that is hashed a byte at a time beside all others.
_SHORT = 48
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def letter_runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of [A-Za-z\\u00C0-\\u00FF] in UTF-8 bytes; all of U+00C0..U+00FF begin with byte C3."""
    n = len(data)
    lead = data == 0xC3
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _LETTER[data] | lead
    inside[2:-1] |= lead[:-1]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def crc32_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, going on from the crc32 `before` it."""
    order = np.argsort(starts - ends, kind="stable")
    at, size = starts[order], (ends - starts)[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for k in range(min(_SHORT, int(size[0]) if len(size) else 0)):
        live = int(np.searchsorted(-size, -k, "left"))  # those longer than k
        x = state[:live]
        state[:live] = _CRC[(x ^ data[at[:live] + k]) & np.uint32(255)] ^ (x >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -_SHORT, "left"))):
        state[i] = zlib.crc32(data[at[i] + _SHORT : at[i] + size[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def count_runs(min_chars: int, damage: int):
    def work(batches):
        for batch in batches:
            for lo, hi, offsets, data in textkit.segments(batch.column(1), 2 << 20):
                low = textkit.lower(data)
                starts, ends, docs = letter_runs(offsets, low)
                inner = np.concatenate(([0], np.cumsum((low & 0xC0) == 0x80)))
                chars = ends - starts - (inner[ends] - inner[starts])
                extra = []
                if damage and len(starts):
                    heads = np.array([zlib.crc32(f"{x}:".encode()) for x in batch.column(0).slice(lo, hi - lo).to_pylist()], np.uint32)
                    crc = crc32_runs(low, starts, ends, heads[docs])
                    hit = crc % np.uint32(damage) == 0
                    for s, e, n, h in zip(starts[hit].tolist(), ends[hit].tolist(), chars[hit].tolist(), crc[hit].tolist()):
                        if n > min_chars:
                            word, k = low[s:e].tobytes().decode(), h % n
                            extra.append(word[:k] + word[k + 1 :])
                    starts, ends, chars = starts[~hit], ends[~hit], chars[~hit]
                starts, ends = starts[chars >= min_chars], ends[chars >= min_chars]
                _, first, n = np.unique(textkit.range_hash(textkit.prefix_hash(low), starts, ends), return_index=True, return_counts=True)
                size = (ends - starts)[first]
                words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(textkit.gather(low, starts[first], size)))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(extra, pa.string())]), pa.concat_arrays([pa.array(n, pa.int64()), pa.array(np.ones(len(extra)), pa.int64())])], ["word", "n"])

    return work


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int = 0) -> DataFrame:
    """(word, n): lower-cased (A-Z) letter runs of min_chars code points or more that occur min_count times or more.

    With damage, a run loses a code point where damage divides the crc32 h of
    "<doc_id>:<run>": the one at h modulo its length. Rows without a doc_id
    are left out; null and empty texts have no runs; equal rows count each.
    """
    textkit.on_workers(docs.sparkSession)
    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(count_runs(min_chars, damage), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Level:
    """Nodes of one depth, sorted by (parent, code point)."""

    def __init__(self, rows, node, parent, code, row_short, keys):
        n = len(parent)
        self.rows, self.node, self.parent, self.code, self.keys = rows, node, parent, code, keys
        self.size = np.bincount(node, minlength=n)
        self.short = np.bincount(node[row_short], minlength=n) > 0
        self.long = np.bincount(node[~row_short], minlength=n) > 0


def child_pairs(u, v, above, below):
    """Children of u in `above` and of v in `below` with the same code point; `above` and `below` hold the children."""
    lo, hi = np.searchsorted(above.parent, u, "left"), np.searchsorted(above.parent, u, "right")
    child = textkit.gather(np.arange(len(above.parent)), lo, hi - lo)
    want = np.repeat(v, hi - lo) << 21 | above.code[child]
    at = np.minimum(np.searchsorted(below.keys, want), max(len(below.keys) - 1, 0))
    hit = below.keys[at] == want if len(below.keys) else np.zeros(len(want), bool)
    return child[hit], at[hit]


def siblings(level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes with the same parent that both have shorter words below."""
    ids = np.flatnonzero(level.short)
    parent, left, right = level.parent[ids], [ids[:0]], [ids[:0]]
    for d in range(1, len(ids)):
        same = np.flatnonzero(parent[d:] == parent[:-d])
        if not len(same):
            break
        left.append(ids[same])
        right.append(ids[same + d])
    return np.concatenate(left), np.concatenate(right)


def near_rows(group: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray, short: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (shorter or equal first, each once) at distance one in their group.

    A row is a word's part in the window of its group: `size` code points from
    `start` in `codes`. `short` marks the words of the group's smaller length;
    `last` the groups whose window reaches the end of the words: elsewhere a
    difference behind the window's last position belongs to the next window.
    """
    out_u, out_v = [group[:0]], [group[:0]]
    root = np.unique(group)
    node = np.searchsorted(root, group)
    here = Level(np.arange(len(group)), node, np.zeros(len(root), np.int64), np.zeros(len(root), np.int64), short, root)

    def deeper(level, depth, paired):
        """The nodes one deeper, of rows that go on and can still be in a pair."""
        alive = (size[level.rows] > depth) & ((level.size > 1) | paired)[level.node]
        rows = level.rows[alive]
        keys, node = np.unique(level.node[alive] << 21 | codes[start[rows] + depth], return_inverse=True)
        return Level(rows, node.astype(np.int64), keys >> 21, keys & (1 << 21) - 1, short[rows], keys)

    def ends(level, depth, is_short):
        """The row that ends at each node, or -1."""
        out = np.full(len(level.parent), -1, np.int64)
        done = (size[level.rows] == depth) & (short[level.rows] == is_short)
        out[level.node[done]] = level.rows[done]
        return out

    empty = np.zeros(0, np.int64)
    below = deeper(here, 0, np.zeros(len(root), bool))
    replaced, inserted = (empty, empty), (below.parent[(keep := here.short[below.parent] & below.long)], np.flatnonzero(keep))
    depth = 0
    while len(here.rows):
        done_here, done_below = ends(here, depth, True), ends(below, depth + 1, False)
        u, v = replaced
        a, b = done_here[u], done_here[v]
        both = (a >= 0) & (b >= 0)
        out_u.append(a[both])
        out_v.append(b[both])
        u, v = inserted
        a, b = done_here[u], done_below[v]
        both = (a >= 0) & (b >= 0) & ((below.parent[v] != u) | last[np.maximum(a, 0)])
        out_u.append(a[both])
        out_v.append(b[both])
        if not len(below.rows):
            break
        paired = np.zeros(len(below.parent), bool)  # nodes of the next depth that are active for others, or have active ones
        next_replaced = tuple(np.concatenate(x) for x in zip(siblings(below), child_pairs(*replaced, below, below)))
        keep = below.short[next_replaced[0]] & below.short[next_replaced[1]]
        next_replaced = tuple(x[keep] for x in next_replaced)
        for x in next_replaced:
            paired[x] = True
        paired[inserted[1]] = True
        grows = np.zeros(len(here.parent), bool)
        grows[inserted[0]] = True
        paired |= grows[below.parent]
        deep = deeper(below, depth + 1, paired)
        own = np.flatnonzero(below.short[deep.parent] & deep.long & (deep.code != below.code[deep.parent]))
        u, v = child_pairs(*inserted, below, deep)
        keep = below.short[u] & deep.long[v]
        next_inserted = np.concatenate([deep.parent[own], u[keep]]), np.concatenate([own, v[keep]])
        here, below, replaced, inserted, depth = below, deep, next_replaced, next_inserted, depth + 1
    return np.concatenate(out_u), np.concatenate(out_v)


def join_subtries(batches):
    """For each word with near words in these subtries: their number, and the best of them."""
    if not (batches := [b for b in batches if b.num_rows]):
        return
    table = pa.Table.from_batches(batches).combine_chunks()
    group = np.asarray(table["key"].chunk(0).dictionary_encode().indices, np.int64)
    rows = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(rows):
        return
    table, group = table.take(pa.array(rows)), group[rows]
    words = table["word"].combine_chunks()
    n, m, a, b = (table[c].to_numpy().astype(np.int64) for c in ("n", "m", "a", "b"))
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    start = np.cumsum(length) - length
    u, v = near_rows(group, codes, start + a, length - a - np.maximum(m - b, 0), length == m, b > m)
    if not len(u):
        return
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[v], -n[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
    yield pa.RecordBatch.from_arrays([words.take(pa.array(u[first])), pa.array(np.diff(np.concatenate((first, [len(u)])))), pa.array(n[v[first]]), words.take(pa.array(v[first]))], ["word", "n_near", "best_n", "best"])


def subtries(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n, m, a, b, key): each word in the subtries that it meets its near words in, none of more than `most` words while its window can be halved."""
    size = F.length("word")
    rows = words.withColumn("m", F.explode(F.array(size, size - 1))).where("m >= 0")
    half = F.expr("(m + 1) div 2").cast("int")
    rows = rows.withColumn("w", F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("m") + 1).alias("b"))))).select("word", "n", "m", "w.a", "w.b").where("a < b")
    key = F.concat_ws("|", "m", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.expr("right(word, greatest(m - b, 0))"))
    rows = rows.withColumn("key", key)
    while True:
        large = textkit.saved(rows.groupBy("key", "a", "b").count().where(F.col("count") > most).where("b - a > 1").select("key"))
        if large.isEmpty():
            textkit.discard(large)
            return rows
        middle = F.expr("(a + b) div 2").cast("int")
        hot = rows.join(F.broadcast(large) if large.count() <= 50_000 else large, "key", "left_semi")
        cut = hot.withColumn("w", F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b")))).select("word", "n", "m", "w.a", "w.b")
        rows = rows.join(F.broadcast(large) if large.count() <= 50_000 else large, "key", "left_anti").select("word", "n", "m", "a", "b", "key").unionByName(cut.withColumn("key", key))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one, by doubling."""
    at = textkit.saved(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = textkit.saved(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        textkit.discard(at)
        if longer.where("moved").isEmpty():
            return longer.drop("moved")
        at = longer.drop("moved")
        at.lexloom_path = longer.lexloom_path


def variants(words: DataFrame, factor: int = FACTOR, most: int = GROUP) -> DataFrame:
    """Near words, forms and roots of a vocabulary (word, n); words are distinct.

    Returns word, form, root, n, n_near, form_n. A word without near words has
    n_near 0 and is its own root; equal counts go to the smaller word in code
    point order. An empty vocabulary gives no rows, null words none; empty words are near to
    nothing but words of one code point, which are near to each other too.
    """
    spark = words.sparkSession
    textkit.on_workers(spark)
    words = textkit.saved(words.select("word", "n").where("word is not null"))
    dealt = subtries(words, most)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * words.count() // ROWS))
    found = dealt.repartition(tasks, "key").mapInArrow(join_subtries, "word string, n_near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    strong = -F.col("top.less") >= factor * F.col("n")
    named = textkit.saved(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("top.best")).alias("form"), F.when(strong, -F.col("top.less")).cast("long").alias("form_n")))
    textkit.discard(words)
    roots = followed(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(textkit.documents(spark, sf_dir), damage=97))


#: crc32 by its table, made from the rule; near words meet over what is left of them without one code point.
OP12_SQL = """
with recursive steps as (select i as byte, 0 as k, i::ubigint as c from range(256) t(i) union all select byte, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from steps where k < 8),
crc as (select list(c order by byte) as t from steps where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) as run from documents where doc_id is not null and text is not null),
met as (select doc_id, run, count(*) as n from runs group by doc_id, run),
bytes as (select doc_id, run, n, list_transform(range(1, strlen(concat(doc_id, ':', run)) + 1), lambda i: ('0x' || substr(hex(concat(doc_id, ':', run)), 2 * i - 1, 2))::ubigint) as b from met where length(run) >= 5),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255)::bigint + 1])), 4294967295::ubigint) as h from bytes, crc),
cut as (select case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from cut where length(word) >= 5 group by word having sum(n) >= 3),
gaps as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from words a join gaps b on a.word = b.rest union select b.word, a.word, a.n from words a join gaps b on a.word = b.rest),
best as (select word, count(*) as n_near, min(row(-other_n, other)) as top from near group by word),
named as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when -b.top[1] >= 2 * w.n then b.top[2] end as form, case when -b.top[1] >= 2 * w.n then -b.top[1] end as form_n from words w left join best b using (word)),
walk as (select word, word as last, 0 as k from named union all select walk.word, named.form, k + 1 from walk join named on walk.last = named.word where named.form is not null)
select word, form, (select arg_max(last, k) from walk where walk.word = named.word) as root, n::bigint as n, n_near::bigint as n_near, form_n::bigint as form_n from named
"""
