"""Synonyms and senses learnt from a corpus: PPMI vectors of terms, an exact similarity join by prefix filtering, clusters of a term's neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import one_thread, small_batches, written

#: Terms on either side that a term occurs with; least occurrences of a pair; contexts that a vector keeps; least cosine of synonyms; neighbours that senses are made of.
WINDOW, LEAST, FEATURES, COSINE, NEIGHBOURS = 2, 5, 50, 0.7, 20
DIGITS = 9
#: Buckets that pairs are counted in before their names are looked at (2^20 to 2^29, a bit each in tasks), in so many parts; counts that a task holds; keys of a row.
SMALLEST, LARGEST, PARTS, HELD, KEYS = 20, 29, 256, 4_000_000, 4096
#: Terms of a block: those that share a context are compared block by block.
BLOCK = 2048


def _apart(ids: np.ndarray, sizes: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of places of a list that are 1 to `window` apart."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    for d in range(1, window + 1):
        same = row[:-d] == row[d:]
        yield ids[:-d][same], ids[d:][same]


def _bucket(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """A bucket for two hashes, in either order."""
    x = (a + b).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _full_buckets(hashes: DataFrame, size: int, window: int, least: int) -> tuple[np.ndarray, int]:
    """A bit for each bucket of pairs that holds `least` occurrences or more, and log2 of their number. hashes: h, an array for each text; size: characters of all texts."""
    bits = min(LARGEST, max(SMALLEST, (window * size).bit_length()))
    width = (1 << bits) // PARTS
    kind = np.min_scalar_type(least)

    def counted(batches):
        def rows():
            key, n = _summed(keys, counts)
            cuts = np.searchsorted(key, np.arange(PARTS + 1) * width)
            at = np.concatenate([np.arange(lo, hi, KEYS) for lo, hi in zip(cuts[:-1], cuts[1:])])
            ends = np.minimum(at + KEYS, cuts[key[at] // width + 1])
            local, n = (key % width).astype(np.uint32), np.minimum(n, least).astype(kind)
            return pa.RecordBatch.from_arrays([pa.array(key[at] // width, pa.int32()), *(pa.array([x[lo:hi].tobytes() for lo, hi in zip(at, ends)], pa.binary()) for x in (local, n))], ["part", "keys", "n"])

        keys, counts, held = [], [], 0
        for batch in batches:
            h = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            for a, b in _apart(h, pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False), window):
                key, n = np.unique(_bucket(a, b, bits), return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
            if held > HELD:
                keys, counts = map(list, zip(_summed(keys, counts)))
                held = len(keys[0])
                if held > HELD // 2:
                    yield rows()
                    keys, counts, held = [], [], 0
        if held:
            yield rows()

    def full(batches):
        part, n = None, np.zeros(width, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(n >= least).tobytes()], pa.binary())], ["part", "bits"])
        for batch in batches:
            for k, keys, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if k != part:
                    if part is not None:
                        yield done()
                    part, n = k, np.zeros(width, np.int64)
                n[np.frombuffer(keys, np.uint32)] += np.frombuffer(counts, kind)
        if part is not None:
            yield done()

    rows = hashes.mapInArrow(counted, "part int, keys binary, n binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((PARTS, width // 8), np.uint8)
    for part, found in rows.mapInArrow(full, "part int, bits binary").collect():
        out[part] = np.frombuffer(found, np.uint8)
    return out.reshape(-1), bits


def cooccurrences(docs: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(term, context, n): times that two terms of a text are `window` places apart at most, in both directions; pairs met fewer than `least` times are left out.

    Null and empty texts have no terms; a term is no context of itself. Most
    pairs are rare, so hashes of pairs are counted in buckets first; a pair can
    be frequent only where its bucket is, and only such pairs are then counted
    by name, in tasks and after a shuffle.
    """
    terms = docs.select(T.terms(F.coalesce("text", F.lit(""))).alias("t"))
    hashes = F.transform("t", lambda x: F.xxhash64(x))
    spark = docs.sparkSession
    small_batches(spark)
    buckets = bits = None
    if least > 1:
        size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        full, bits = _full_buckets(terms.select(hashes.alias("h")), size, window, least)
        buckets = spark.sparkContext.broadcast(full)

    def counted(batches):
        def rows():
            at, n = _summed(keys, counts)
            return pa.RecordBatch.from_arrays([names.take(pa.array(at >> 32)), names.take(pa.array(at & 0xFFFFFFFF)), pa.array(n)], ["a", "b", "n"])

        keys, counts, held, names = [], [], 0, pa.array([], pa.string())
        for batch in batches:
            own = batch.column(0).flatten().cast(pa.string()).dictionary_encode()
            known = pc.index_in(own.dictionary, value_set=names)
            new = own.dictionary.filter(pc.is_null(known))
            names = pa.concat_arrays([names, new])
            code = pc.index_in(own.dictionary, value_set=names).to_numpy().astype(np.int64)[own.indices.to_numpy()]
            sizes = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            h = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            for (a, b), (x, y) in zip(_apart(code, sizes, window), _apart(h, sizes, window)):
                kept = a != b
                if buckets is not None:
                    k = _bucket(x, y, bits)
                    kept &= (buckets.value[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)
                a, b = a[kept], b[kept]
                key, n = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b), return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
            if held > HELD:
                keys, counts = map(list, zip(_summed(keys, counts)))
                held = len(keys[0])
                if held > HELD // 2:
                    yield rows()
                    keys, counts, held, names = [], [], 0, pa.array([], pa.string())
        if held:
            yield rows()

    made = terms.select("t", hashes.alias("h")).mapInArrow(counted, "a string, b string, n long")
    counted_pairs = made.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    both = F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("context")), F.struct(F.col("b").alias("term"), F.col("a").alias("context")))
    return counted_pairs.select("n", F.explode(both).alias("x")).select("x.term", "x.context", "n")


def ppmi(counts: DataFrame) -> DataFrame:
    """(term, context, w): ln(n N / (n_term n_context)) where that is above 0."""
    counts = written(counts)
    margin = written(counts.groupBy("term").agg(F.sum("n").alias("m")))
    total = margin.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    w = F.round(F.log(F.col("n") * F.lit(float(total)) / (F.col("m").cast("double") * F.col("k"))), DIGITS)
    rows = counts.join(margin, "term").join(margin.select(F.col("term").alias("context"), F.col("m").alias("k")), "context")
    return rows.select("term", "context", w.alias("w")).where("w > 0")


def unit_vectors(weights: DataFrame, features: int = FEATURES) -> DataFrame:
    """(term, context, x): the largest `features` weights of a term (equal ones by context), scaled to length 1."""
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), "context"))
    kept = weights.withColumn("rank", rank).where(F.col("rank") <= features)
    return kept.select("term", "context", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("term")))).alias("x"))


def packed(vectors: DataFrame) -> DataFrame:
    """(term, v), written, one row for each term: its (code, x, df), codes in the order of how many terms have a context, rare ones first."""
    vectors = written(vectors)
    order = written(vectors.groupBy("context").agg(F.count("*").alias("df")).orderBy("df", "context").withColumn("code", F.monotonically_increasing_id()))
    return written(vectors.join(order, "context").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("code", "x", "df"))).alias("v")))


def _prefixes(rows: DataFrame, least: float) -> DataFrame:
    """(g, term, asked, codes, xs): a term with its shared contexts, once for each context g of its prefix."""

    def made(batches):
        for batch in batches:
            v = batch.column(2).flatten()
            code, x, df = (pc.struct_field(v, k).to_numpy(zero_copy_only=False) for k in range(3))
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            upto = np.cumsum(x * x)
            rest = upto[np.repeat(np.cumsum(sizes), sizes) - 1] - upto + x * x if len(x) else x
            shared = df > 1
            begins = pa.array(np.searchsorted(row[shared], np.arange(len(sizes) + 1)), pa.int32())
            at = np.flatnonzero(shared & (np.sqrt(np.maximum(rest, 0)) >= least - 1e-9))
            whose = pa.array(row[at])
            lists = (pa.ListArray.from_arrays(begins, pa.array(c[shared])).take(whose) for c in (code, x))
            yield pa.RecordBatch.from_arrays([pa.array(code[at]), batch.column(0).take(whose), batch.column(1).take(whose), *lists], ["g", "term", "asked", "codes", "xs"])

    return rows.select("term", "asked", "v").mapInArrow(made, "g long, term string, asked boolean, codes array<long>, xs array<double>")


def _links(rows: pa.Table, g: int, lo: int, hi: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links of the asked terms of two blocks (or of one with itself) whose first shared context is g; the k best of a term, or all (0)."""
    rows = rows.take(pc.sort_indices(rows, [("term", "ascending")]))
    term, asked, right = rows.column("term").combine_chunks(), *(rows.column(c).to_numpy() for c in ("asked", "right"))
    codes = rows.column("codes").combine_chunks()
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(codes).to_numpy(zero_copy_only=False))
    context, at, n = np.unique(codes.flatten().to_numpy(), return_inverse=True, return_counts=True)
    x = rows.column("xs").combine_chunks().flatten().to_numpy()
    order = np.argsort(at, kind="stable")
    order = order[n[at[order]] > 1]
    column, row, x = (np.cumsum(n > 1) - 1)[at[order]], row[order], x[order]
    shared, before = int((n > 1).sum()), int((n[context < g] > 1).sum())
    lone = lo == hi
    for one, other in [(~right, ~right)] if lone else [(~right, right), (right, ~right)]:
        p, q = np.flatnonzero(one & asked), np.flatnonzero(other)
        if not len(p) or len(q) < 1 + lone:
            continue
        cos, met = np.zeros((len(p), len(q))), np.zeros((len(p), len(q)), bool)
        for begin, end in [(c, min(c + 512, before)) for c in range(0, before, 512)] + [(c, min(c + 512, shared)) for c in range(before, shared, 512)]:
            some = slice(*np.searchsorted(column, (begin, end)))
            wide = np.zeros((len(rows), end - begin))
            wide[row[some], column[some] - begin] = x[some]
            if end <= before:
                met |= (wide[p] > 0).astype(np.float32) @ (wide[q] > 0).astype(np.float32).T > 0
            else:
                cos += wide[p] @ wide[q].T
        cos = np.round(cos, DIGITS)
        cos[met] = -1
        if lone:
            cos[p[:, None] == q] = -1
        found = cos >= least
        if k and k < len(q):
            last = np.partition(cos, -k, axis=1)[:, -k:].min(axis=1)[:, None]
            more, ties = cos > last, cos == last
            found &= more | (ties & (np.cumsum(ties, axis=1) <= k - more.sum(axis=1)[:, None]))
        a, b = np.nonzero(found)
        for begin in range(0, len(a), 100_000):
            i, j = a[begin : begin + 100_000], b[begin : begin + 100_000]
            yield pa.RecordBatch.from_arrays([term.take(pa.array(p[i])), term.take(pa.array(q[j])), pa.array(cos[i, j])], ["term", "other", "cos"])


def _joined(vectors: DataFrame, least: float, k: int, asked: DataFrame | None) -> DataFrame:
    """(term, other, cos) of packed vectors: all links, or of each pair of blocks the k best of a term.

    A term's prefix ends where the length of what follows falls below `least`:
    two terms that share nothing in their prefixes can't reach it, whatever
    else they share. Terms meet in the groups of their prefixes' contexts, with
    their vectors, and a pair is taken where its first shared context is. Large
    groups are cut into blocks, and pairs of blocks are dealt to tasks.
    """
    one_thread(vectors.sparkSession)
    rows = vectors.withColumn("asked", F.lit(True)) if asked is None else vectors.join(asked.select("term", F.lit(True).alias("asked")).distinct(), "term", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    members = _prefixes(rows, least)
    if asked is not None:
        members = members.join(written(members.where("asked").select("g").distinct()), "g", "left_semi")
    large = written(members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    placed = members.join(F.broadcast(large), "g", "left").withColumn("i", F.coalesce(F.pmod(F.xxhash64("term"), "blocks").cast("int"), F.lit(0)))
    pairs = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    cells = placed.select("*", pairs.alias("j")).select("g", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("right"), "term", "asked", "codes", "xs")

    def compared(batches):
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                now = tuple(keys[:, lo].tolist())
                if now != key and sum(map(len, held)) > 1:
                    yield from _links(pa.Table.from_batches(held), *key, k, least)
                key, held = now, [*(held if now == key else []), batch.slice(lo, hi - lo)]
        if sum(map(len, held)) > 1:
            yield from _links(pa.Table.from_batches(held), *key, k, least)

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(compared, "term string, other string, cos double")


def similar(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """(term, other, cos) of all pairs with a cosine of `least` or more, in both directions; least above 0."""
    return _joined(packed(vectors), least, 0, None)


def nearest(vectors: DataFrame, k: int, least: float = COSINE, asked: DataFrame | None = None) -> DataFrame:
    """synonyms(similar(...), k) of packed vectors, of all terms or those asked (column term), where a task sends the k best of a term and not all links."""
    return synonyms(_joined(vectors, least, k, asked), k)


def learnt(docs: DataFrame, window: int = WINDOW, least: int = LEAST, features: int = FEATURES, cosine: float = COSINE) -> DataFrame:
    """(term, other, cos) of a corpus (column text)."""
    return similar(unit_vectors(ppmi(cooccurrences(docs, window, least)), features), cosine)


def learnt_vectors(docs: DataFrame) -> DataFrame:
    """The packed vectors of a corpus, for nearest and senses_of."""
    return packed(unit_vectors(ppmi(cooccurrences(docs))))


def synonyms(links: DataFrame, k: int = 5) -> DataFrame:
    """(term, synonym, weight): the k most similar terms of each, for retrieve.expanded."""
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("cos"), "other"))
    return links.withColumn("rank", rank).where(F.col("rank") <= k).select("term", F.col("other").alias("synonym"), F.col("cos").alias("weight"))


def senses(links: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(term, sense, members, weight): a term's k nearest neighbours, in groups that links between them hold together.

    Groups are numbered by their largest cosine (equal ones by their first
    member); members are in order. A row holds k neighbours and k * k links at most.
    """
    near = written(synonyms(links, k))
    ends = near.select("term", F.col("synonym").alias("a")).join(links.select(F.col("term").alias("a"), F.col("other").alias("b")), "a")
    inside = ends.where("a < b").join(near.select("term", F.col("synonym").alias("b")), ["term", "b"]).groupBy("term").agg(F.collect_list(F.struct("a", "b")).alias("links"))
    held = near.groupBy("term").agg(F.collect_list(F.struct("synonym", "weight")).alias("near")).join(inside, "term", "left")

    def grouped(batches):
        for batch in batches:
            out = []
            for term, around, pairs in zip(batch["term"], batch["near"], batch["links"]):
                root = {x["synonym"]: x["synonym"] for x in around}

                def find(x, root=root):
                    while root[x] != x:
                        x = root[x]
                    return x

                for p in pairs if pairs is not None else ():
                    a, b = sorted((find(p["a"]), find(p["b"])))
                    root[b] = a
                groups: dict[str, list] = {}
                for x in around:
                    groups.setdefault(find(x["synonym"]), []).append((x["synonym"], float(x["weight"])))
                ordered = sorted(groups.values(), key=lambda g: (-max(w for _, w in g), min(g)))
                out += [(term, n + 1, sorted(m for m, _ in g), max(w for _, w in g)) for n, g in enumerate(ordered)]
            yield pd.DataFrame(out, columns=["term", "sense", "members", "weight"])

    return held.mapInPandas(grouped, "term string, sense int, members array<string>, weight double")


def senses_of(vectors: DataFrame, k: int = NEIGHBOURS, least: float = COSINE, asked: DataFrame | None = None) -> DataFrame:
    """senses(similar(...), k) of packed vectors, of all terms or those asked: links between a term's neighbours are found from their vectors, beside each other in a row."""
    near = nearest(vectors, k, least, asked)
    shared = F.filter("v", lambda c: c["df"] > 1)
    beside = near.join(vectors.select(F.col("term").alias("synonym"), F.transform(shared, lambda c: c["code"]).alias("codes"), F.transform(shared, lambda c: c["x"]).alias("xs")), "synonym")
    held = beside.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("synonym", "weight", "codes", "xs"))).alias("v"))

    def grouped(batches):
        for batch in batches:
            v = batch.column(1).flatten()
            names, weights, codes, xs = (pc.struct_field(v, c) for c in range(4))
            weights, sizes = weights.to_numpy(), pc.list_value_length(codes).to_numpy(zero_copy_only=False)
            codes, xs = codes.flatten().to_numpy(), xs.flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)).tolist()
            entries = np.append(0, np.cumsum(sizes))
            row, sense, best, order, cuts = [], [], [], [], [0]
            for r, (lo, hi) in enumerate(zip([0, *ends], ends)):
                some = slice(entries[lo], entries[hi])
                context, at = np.unique(codes[some], return_inverse=True)
                wide = np.zeros((hi - lo, len(context)))
                wide[np.repeat(np.arange(hi - lo), sizes[lo:hi]), at] = xs[some]
                near = (np.round(wide @ wide.T, DIGITS) >= least) | np.eye(hi - lo, dtype=bool)
                for _ in range((hi - lo).bit_length()):  # neighbours of neighbours, twice as far each time
                    near = near.astype(np.float32) @ near.astype(np.float32) > 0
                first = near.argmax(axis=1)  # members are in order
                groups = {f: [] for f in first.tolist()}
                for m, f in enumerate(first.tolist()):
                    groups[f].append(lo + m)
                for n, (w, f) in enumerate(sorted((-weights[g].max(), f) for f, g in groups.items())):
                    row.append(r)
                    sense.append(n + 1)
                    best.append(-w)
                    order += groups[f]
                    cuts.append(len(order))
            members = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), names.take(pa.array(order, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(sense, pa.int32()), members, pa.array(best, pa.float64())], ["term", "sense", "members", "weight"])

    return held.mapInArrow(grouped, "term string, sense int, members array<string>, weight double")


def fitting_synonyms(terms: DataFrame, groups: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, term, synonym, weight): for each term of a query (qid, term) the members of the sense that goes best with its other terms.

    A sense's fit is the sum of the PPMI weights of its members with those
    terms; equal ones, as in a query of one term, by the sense's number.
    """
    asked = written(terms.select("qid", "term").distinct())
    choices = written(asked.join(groups, "term"))
    members = choices.select("qid", "term", "sense", F.explode("members").alias("member"))
    others = asked.select("qid", F.col("term").alias("context"))
    fit = members.join(others, "qid").where("context <> term").join(weights.select(F.col("term").alias("member"), "context", "w"), ["member", "context"]).groupBy("qid", "term", "sense").agg(F.round(F.sum("w"), DIGITS).alias("fit"))
    rank = F.row_number().over(Window.partitionBy("qid", "term").orderBy(F.desc(F.coalesce("fit", F.lit(0.0))), "sense"))
    best = choices.join(fit, ["qid", "term", "sense"], "left").withColumn("rank", rank).where("rank = 1")
    return best.select("qid", "term", F.explode("members").alias("synonym"), "weight")
