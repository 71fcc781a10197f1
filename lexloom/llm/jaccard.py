"""op10: exact Jaccard join of documents' word n-grams, in a metric space.

1. A sketch of all shingles (one counter for about each shingle, cut into
   slices that are summed independently) tells shingles that no second
   document can have from shared ones, and rare ones from frequent ones. Two
   sets with Jaccard similarity t share a shingle among the first
   n - ceil(t n) + 1 of either, in any common order; the order is by the
   sketch's levels, unshared shingles first. Of the smaller set the first
   n - ceil(2 t n / (1 + t)) + 1 are enough: shingles that no set has so far in
   front are left out, so documents that share a passage and are not linked don't
   meet over it. Documents whose prefix holds
   unshared shingles alone have no links. Counters that collide only make more
   candidates, so this loses no link.
2. Equal sets become one node. The members of each prefix shingle elect a
   pivot, the one with the smallest hash. A pivot's region holds all nodes that
   meet it over some shingle: of the regions that a node meets, the one of its
   nearest pivot is its Voronoi region, and the others are those to which it is
   replicated. Linked nodes share a prefix shingle, so they meet in the region
   of that shingle's pivot.
3. A region is joined exactly in parts of a bounded number of shingles, each
   with the region's pivot. Inside a part the same step repeats: members meet
   over the part's rarest shingles, centres elected among them begin cells, a
   member is compared with the centres of the cells that it meets and then only
   with members for which the triangle inequality, from the two distances to
   their centre, leaves room for a link.
4. Regions of several parts go on: members that their part has linked with the
   pivot are settled among themselves. The others are open; they are cut into
   rings by their distance to the pivot, and each ring is joined with the
   members of its triangle-inequality window (all distances that differ by the
   radius at most), again in parts of bounded size.
5. Links of all regions are closed to components.

A part holds CELL shingles at most beside its pivot and its last member, at
every size of the input; step 4 costs the product of a region's open members
and their windows.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .components import connected_components
from .sketches import bucket_bits, levels, shared_buckets

SHINGLE = 5
#: Shingles of a region's part.
CELL = 500_000
#: Width of a ring of distances to a pivot, as a share of the radius.
RING = 0.5


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int = SHINGLE):
    """The sorted distinct shingle hashes of each text of a segment."""
    data = textkit.lower(data)
    starts, ends, docs = textkit.word_spans(offsets, data)
    words = textkit.range_hash(textkit.prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = textkit.gram_hash(words, n)
    counts = np.bincount(docs, minlength=len(offsets) - 1)
    first = np.cumsum(counts) - counts
    for k in range(len(counts)):
        c, s = int(counts[k]), int(first[k])
        if c >= n:
            yield unique(grams[s : s + c - n + 1])
        elif c:
            yield textkit.gram_hash(words[s : s + c], c) ^ np.uint64(0x5851F42D4C957F2D * c & (1 << 64) - 1)
        else:
            yield grams[:0]


def unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def overlaps(linked_num: int, linked_den: int, common, a, b):
    """100 * intersection >= 75 * union, in whole numbers, for the given threshold."""
    return linked_den * common >= linked_num * (a + b - common)


def index_prefix(n: int, num: int, den: int) -> int:
    """Shingles of a set of n, rarest first, of which it shares one with each linked set that is as large or larger."""
    return n - -(-2 * num * n // (num + den)) + 1


def join_region(sets: list[np.ndarray], num: int = 75, den: int = 100, active: np.ndarray | None = None) -> list[int]:
    """Components of the exact threshold join of some sets: for each the first member of its component.

    Members come by size. Each meets the earlier ones that have one of its
    rarest shingles (as many as a linked pair must share one of) among their
    own, of which a smaller set needs fewer, that are not too small, and for
    which enough shingles are left behind that one. Its distance to the centres of their cells is computed first; a
    member of another component is compared only if the triangle inequality
    leaves room for a link. A member within the radius of a centre joins its
    cell, others begin one. Members of one component are never compared again.
    With `active`, only pairs with an active member need be found.
    """
    n, radius = len(sets), 1 - num / den
    sizes = np.array([len(s) for s in sets])
    active = np.ones(n, bool) if active is None else active
    # shingles that only one member has can't link it; counted in slices of the hash range, so that little is held at once
    bits = max(0, int(sizes.sum()).bit_length() - 18)
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    cuts = [np.concatenate(([0], np.searchsorted(s, edges), [len(s)])) for s in sets]
    found, counts = [], []
    for k in range(len(edges) + 1):
        every = np.concatenate([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)])
        every.sort()
        twice = unique(every[1:][every[1:] == every[:-1]])
        found.append(twice)
        counts.append((np.searchsorted(every, twice, "right") - np.searchsorted(every, twice, "left")).astype(np.int32))
    flat, count = np.concatenate(found), np.concatenate(counts)
    del every, twice, found, counts, cuts
    shared = []
    for s in sets:
        at = np.searchsorted(flat, s)
        inside = at < len(flat)
        inside[inside] = flat[at[inside]] == s[inside]
        shared.append(at[inside].astype(np.int32))
    mark = np.zeros(len(flat), bool)
    label = np.arange(n)
    members = {k: [k] for k in range(n)}
    centre, reach = np.arange(n), np.zeros(n)
    postings: tuple[dict[int, tuple[array, array]], ...] = ({}, {})  # members and the places of a shingle in them; of passive and of active members

    def union(a: int, b: int) -> None:
        a, b = int(label[a]), int(label[b])
        if a != b:
            if len(members[a]) < len(members[b]):
                a, b = b, a
            label[members[b]] = a
            members[a] += members.pop(b)

    for x in np.argsort(sizes, kind="stable").tolist():
        size = int(sizes[x])
        own = shared[x]
        alone = size - len(own)
        first = size - -(-num * size // den) + 1 - alone  # after the shingles of x alone
        rare = own[np.lexsort((own, count[own]))[: max(0, first)]].tolist()
        met = [np.zeros(0, np.int64)]
        for place, t in enumerate(rare):
            for kind in (1, 0) if active[x] else (1,):
                if t in postings[kind]:
                    k, at = (np.frombuffer(a, np.int64) for a in postings[kind][t])
                    left = np.minimum(size - alone - place, sizes[k] - at)  # most that the two can share
                    met.append(k[((num + den) * left >= num * (size + sizes[k])) & (den * sizes[k] >= num * size)])
        met = np.unique(np.concatenate(met))
        k = at = left = None  # the buffers can grow again
        if len(met):
            mark[own] = True

            def compare(k: int) -> tuple[float, bool]:
                common = int(mark[shared[k]].sum())
                return 1 - common / (size + int(sizes[k]) - common), bool(overlaps(num, den, common, size, int(sizes[k])))

            far = {}
            for c in np.unique(centre[met]).tolist():
                far[c], near = compare(c)
                if near:
                    union(x, c)
                    if centre[x] == x or far[c] < reach[x]:
                        centre[x], reach[x] = c, far[c]
            for k in met.tolist():
                if label[k] != label[x] and abs(far[int(centre[k])] - reach[k]) <= radius + 1e-9 and compare(k)[1]:
                    union(x, k)
            mark[own] = False
        for place, t in enumerate(rare[: max(0, index_prefix(size, num, den) - alone)]):
            k, at = postings[int(active[x])].setdefault(t, (array("q"), array("q")))
            k.append(x)
            at.append(alone + place)
    least = {}
    for k in range(n):
        least.setdefault(int(label[k]), k)
    return [least[int(label[k])] for k in range(n)]


def joined(rows: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """(region, a, b, d, open): each member of a part linked with the first of its component there.

    rows: region, part, pivot, node, active, shingles. Of rows with `active`
    null, all pairs are joined, d is the distance to the part's pivot, and
    `open` tells whether the part leaves the member apart from it; the others
    give links alone.
    """

    def work(batches):
        key, nodes, flags, sets, held = None, [], [], [], []

        def flush():
            if len(nodes) > 1:
                region, _, pivot = key
                first = flags[0] is None
                roots = join_region(sets, num, den, None if first else np.array(flags))
                at = nodes.index(pivot) if first else -1
                for k, r in enumerate(roots):
                    if first:
                        common = len(np.intersect1d(sets[k], sets[at], assume_unique=True))
                        held.append((region, nodes[k], nodes[r], 1 - common / (len(sets[k]) + len(sets[at]) - common), r != roots[at]))
                    elif k != r:
                        held.append((region, nodes[k], nodes[r], None, None))
            nodes.clear()
            flags.clear()
            sets.clear()

        def out():
            columns = list(zip(*held)) or [()] * 5
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["region", "a", "b", "d", "open"])

        for batch in batches:
            for region, part, pivot, node, active, blob in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
                if (region, part, pivot) != key:
                    flush()
                    key = (region, part, pivot)
                elif nodes and node == nodes[-1]:  # rows that share a doc_id and a set
                    continue
                nodes.append(node)
                flags.append(active)
                sets.append(np.frombuffer(blob.as_buffer(), "<u8"))
            if len(held) > 50_000:
                yield out()
        flush()
        if held:
            yield out()

    ready = rows.select("region", "part", "pivot", "node", "active", "shingles").repartition("region", "part").sortWithinPartitions("region", "part", "pivot", "node")
    return ready.mapInArrow(work, "region long, a long, b long, d double, open boolean")


def joined_regions(meets: DataFrame, sets: DataFrame, num: int = 75, den: int = 100, cell: int = CELL) -> DataFrame:
    """(a, b): links of all regions. meets: region (its pivot's node), node, n; sets: node, shingles."""
    radius = 1 - num / den
    none = F.lit(None).cast("boolean")
    parts = textkit.saved(meets.groupBy("region").agg(F.ceil(F.sum(F.col("n").cast("long")) / cell).cast("int").alias("parts")).where("parts > 1"))
    large = parts.count()
    if not large:
        placed = meets.select("region", F.lit(0).alias("part"), "node")
    else:
        many = F.coalesce("parts", F.lit(1))
        own = F.when(F.col("node") == F.col("region"), F.sequence(F.lit(0), many - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "region"), many).cast("int")))
        placed = meets.join(textkit.sized(parts, 12), "region", "left").select("region", F.explode(own).alias("part"), "node")
    links = joined(sets.join(textkit.sized(placed, 24), "node").select("region", "part", F.col("region").alias("pivot"), "node", none.alias("active"), "shingles"), num, den)
    if not large:
        return links.where("a <> b").select("a", "b")
    links = textkit.saved(links)
    # members of large regions; the pivot is in each part
    state = links.join(textkit.sized(parts, 12), "region", "left_semi").where("a <> region").select("region", F.col("a").alias("node"), "d", "open").join(meets, ["region", "node"])
    width = RING * radius
    ring = F.floor(F.col("d") / width).cast("int")
    rings = state.where("open").groupBy("region", ring.alias("ring")).agg(F.ceil(2 * F.sum(F.col("n").cast("long")) / cell).cast("int").alias("blocks"))
    window = state.join(rings, "region").where((F.col("d") >= F.col("ring") * width - radius - 1e-9) & (F.col("d") <= (F.col("ring") + 1) * width + radius + 1e-9))
    window = textkit.saved(window.withColumn("active", F.col("open") & (ring == F.col("ring"))))
    chunks = window.groupBy("region", "ring").agg(F.ceil(2 * F.sum(F.col("n").cast("long")) / cell).cast("int").alias("chunks"))
    block, chunk = F.pmod(F.xxhash64("node", "region"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("region", "node"), F.col("chunks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = window.join(chunks, ["region", "ring"]).withColumns({"block": block, "chunk": chunk})
    passive = both.withColumn("k", every("blocks")).where(~F.col("active") | (F.col("k") != F.col("block"))).select("region", "ring", F.col("k").alias("block"), "chunk", "node", F.lit(False).alias("active"))
    active = both.where("active").withColumn("k", every("chunks")).select("region", "ring", "block", F.col("k").alias("chunk"), "node", F.lit(True).alias("active"))
    rest = passive.union(active).select("region", F.xxhash64("ring", "block", "chunk").alias("part"), F.col("ring").cast("long").alias("pivot"), "node", "active")
    more = joined(sets.join(rest, "node"), num, den)
    return links.where("a <> b").select("a", "b").union(more.select("a", "b"))


def jaccard_groups(docs: DataFrame, num: int = 75, den: int = 100, cell: int = CELL) -> DataFrame:
    """One row for each row with a doc_id: doc_id, n_shingles, component_id.

    Rows without a doc_id are left out. Null texts and texts without words
    have no shingles and link with nothing; texts with fewer words than a
    shingle have their whole sequence as the only one. Rows that share a
    doc_id are each their own document; equal rows give equal results. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    textkit.on_workers(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(n_bytes / 6)
    load = n_bytes / 6 / (1 << bits)  # of a bucket; only more than that tells frequent shingles
    steps = (1, int(load + 3 * load**0.5 + 3), int(load + 6 * load**0.5 + 32))
    bitmaps = spark.sparkContext.broadcast(shared_buckets(docs, lambda offsets, data: [*shingle_sets(offsets, data)], bits, steps))

    def nodes(batches):
        maps = bitmaps.value
        for batch in batches:
            for lo, hi, offsets, data in textkit.segments(batch.column(1)):
                size, node, blobs, prefixes, fronts = [], [], [], [], []
                for s in shingle_sets(offsets, data):
                    n = len(s)
                    size.append(n)
                    if not n:
                        node.append(None)
                        blobs.append(None)
                        prefixes.append(None)
                        fronts.append(None)
                        continue
                    node.append(int(textkit.mix(np.array([int(s.sum(dtype=np.uint64)) ^ int(np.bitwise_xor.reduce(textkit.mix(s))) * 3 + n & (1 << 64) - 1], np.uint64)).view(np.int64)[0]))
                    level = levels(maps, s, bits)
                    first = n - -(-num * n // den) + 1
                    if int((level == 0).sum()) >= first:
                        blobs.append(None)
                        prefixes.append(None)
                        fronts.append(None)
                        continue
                    order = np.argsort(level, kind="stable")[:first]
                    blobs.append(s.astype("<u8").tobytes())
                    prefixes.append(s[order[level[order] > 0]].view(np.int64).tolist())
                    fronts.append(int((level[order[: index_prefix(n, num, den)]] > 0).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(blobs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(fronts, pa.int32())], ["doc_id", "n_shingles", "node", "shingles", "prefix", "front"])

    rows = textkit.saved(docs.mapInArrow(nodes, "doc_id long, n_shingles long, node long, shingles binary, prefix array<long>, front int"))
    bitmaps.destroy()  # all that needs them is written
    candidates = rows.where("shingles is not null")
    prefix = textkit.saved(candidates.select("node", "front", F.posexplode("prefix").alias("at", "token")).select("node", "token", (F.col("at") < F.col("front")).alias("front")).distinct())
    # a shingle that is in front of no set brings no linked pair together
    pivots = textkit.saved(prefix.groupBy("token").agg(F.min("node").alias("region"), F.count("*").alias("m"), F.max("front").alias("front")).where("m > 1 and front").select("token", "region"))
    met = prefix.join(pivots, "token").select("region", "node").distinct()
    # one document stands for a node
    chosen = candidates.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").cast("int").alias("n"))
    meets = textkit.saved(met.join(chosen, "node").select("region", "node", "n", "doc_id"))
    chosen = textkit.saved(meets.select("node", "doc_id").distinct())
    sets = candidates.select("node", "doc_id", "shingles").join(textkit.sized(chosen, 24), ["node", "doc_id"], "left_semi").select("node", "shingles")
    links = joined_regions(meets.drop("doc_id"), sets, num, den, cell)
    roots = textkit.saved(connected_components(links))
    textkit.discard(prefix, pivots, meets, chosen)
    named = rows.where("node is not null").select("doc_id", "n_shingles", "node").join(textkit.sized(roots, 24), "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("group"))
    # only groups of several rows need a minimum; it is written, so that both sides of the join are dealt for it alone
    least = textkit.saved(named.groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where("m > 1").select("group", "least"))
    with_sets = named.join(textkit.sized(least, 24), "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    return with_sets.union(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(textkit.documents(spark, sf_dir))
