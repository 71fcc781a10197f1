"""Signed hashing embeddings, principal components, nearest vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Most bytes of the queries of one search by brute force; VectorIndex.search has no such bound.
QUERY_BYTES = 24 << 20


def features(text: Column) -> Column:
    """Lower-case tokens and their neighbours joined by `_`."""
    tokens = F.transform(T.embedding_tokens(text), F.lower)
    return T.bind(tokens, lambda t: F.concat(t, F.when(F.size(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.concat(F.get(t, i), F.lit("_"), F.get(t, i + 1))))))


def embeddings(docs: DataFrame, dim: int = 64) -> DataFrame:
    """(doc_id, embedding): signed counts of features by hash, L2-normalised; a text without tokens has zeros.

    Cells are summed where their features are made, so a text sends one row
    for each of its cells, `dim` at most, and never its features.
    """
    hashed = docs.select("doc_id", F.explode_outer(features(F.coalesce("text", F.lit("")))).alias("f")).select("doc_id", T.fnv1a(F.col("f")).alias("h"))
    sign = F.when(F.shiftright("h", 16).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)
    cells = hashed.groupBy("doc_id", F.pmod("h", F.lit(dim)).cast("int").alias("cell")).agg(F.sum(sign).cast("double").alias("v"))
    some = F.col("cell").isNotNull()
    rows = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(some, F.struct("cell", "v")))).alias("m"), F.sqrt(F.coalesce(F.sum(F.when(some, F.col("v") * F.col("v"))), F.lit(0.0))).alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.when(F.col("n") == 0, 1.0).otherwise(F.col("n")))
    return rows.select("doc_id", dense.alias("embedding"))


def fnv1a(texts: list[str]) -> np.ndarray:
    """functions.text.fnv1a of many texts at once: 32-bit FNV-1a over UTF-16 code units."""
    units = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    size = np.array([len(u) // 2 for u in units], np.int64)
    order = np.argsort(-size, kind="stable")  # texts that have a next unit come first
    begin, flat = (np.cumsum(size) - size)[order], np.frombuffer(b"".join(units), "<u2").astype(np.uint64)
    left = len(texts) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), side="right")
    h = np.full(len(texts), 2166136261, np.uint64)
    for k, n in enumerate(left.tolist()):
        h[:n] = ((h[:n] ^ flat[begin[:n] + k]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty_like(h)
    out[order] = h
    return out.astype(np.int64)


def token_id_sums(docs: DataFrame, size: int = 50_000) -> DataFrame:
    """(doc_id, n, total, largest) over the ids of a text's distinct embedding tokens; each token of a batch is hashed once."""

    def summed(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy()
            words = batch.column(1).flatten().dictionary_encode()
            ids = (fnv1a(words.dictionary.to_pylist()) % size)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
            some = np.flatnonzero(sizes)
            begin = (np.cumsum(sizes) - sizes)[some]
            total, largest = (f.reduceat(ids, begin) if len(some) else ids for f in (np.add, np.maximum))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(sizes[some], pa.int64()), pa.array(total, pa.int64()), pa.array(largest, pa.int32())], ["doc_id", "n", "total", "largest"])

    tokens = F.transform(F.array_distinct(T.embedding_tokens(F.col("text"))), F.lower)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", tokens.alias("t")).mapInArrow(summed, f"doc_id {kind}, n long, total long, largest int")
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest"))


def nearest(queries: DataFrame, items: DataFrame, k: int = 5, min_cos: float | None = None) -> DataFrame:
    """(qid, item_id, cos, rank) by brute force over all items; rows: qid, v and item_id, v.

    Queries are a stated set of QUERY_BYTES at most, so they are broadcast; each
    item meets them in one pass, and a task keeps the best k of a query before
    anything is shuffled.
    """
    if (queries.agg(F.sum(8 * F.coalesce(F.size("v"), F.lit(0)) + 24)).first()[0] or 0) > QUERY_BYTES:
        raise ValueError(f"{QUERY_BYTES} bytes of queries at a time at most")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "item_id"))
    if k and _plain(queries, "qid") and _plain(items, "item_id"):
        found = _nearest_of_tasks(queries, items, k)
        found = found if min_cos is None else found.where(F.col("cos") >= min_cos)
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
    q = queries.select("qid", F.col("v").alias("qv"))
    scored = items.select("item_id", "v").crossJoin(F.broadcast(q)).select("qid", "item_id", F.round(V.cosine(F.col("qv"), F.col("v")), 9).alias("cos"))
    if min_cos is not None:
        scored = scored.where(F.col("cos") >= min_cos)
    return scored.withColumn("rank", rank).where(F.col("rank") <= k) if k else scored.withColumn("rank", rank)


def _plain(rows: DataFrame, key: str) -> bool:
    """Whether keys are whole numbers and vectors arrays of numbers of one size, without gaps."""
    if rows.schema[key].dataType.typeName() not in ("long", "integer"):
        return False
    odd = F.col(key).isNull() | F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > 1e100))
    sizes = rows.agg(F.count("*"), F.sum(odd.cast("int")), F.min(F.size("v")), F.max(F.size("v"))).first()
    return bool(sizes[0]) and not sizes[1] and sizes[2] == sizes[3] > 0


def _nearest_of_tasks(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(qid, item_id, cos): of each task the k nearest items of each query. A matrix product names them, and their cosines are then summed cell by cell as functions.vectors does."""
    held = queries.select("qid", F.transform("v", lambda x: x.cast("double")).alias("v")).toArrow()
    names, q = held.column(0).combine_chunks(), held.column(1).combine_chunks().flatten().to_numpy().reshape(len(held), -1)

    def norms(x):
        out = np.zeros(len(x))
        for j in range(x.shape[1]):
            out += x[:, j] * x[:, j]
        return np.sqrt(out)

    def best(batches):
        size = norms(q)
        unit = q / np.where(size == 0, 1.0, size)[:, None]
        top, ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for batch in batches:
            doc, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            length = norms(v)
            scaled = (v / np.where(length == 0, 1.0, length)[:, None]).T
            for lo in range(0, len(q), 256):
                cos = unit[lo : lo + 256] @ scaled
                least = top[lo : lo + 256, -1]
                if len(doc) >= k:
                    least = np.maximum(least, np.partition(cos, -k, axis=1)[:, -k])
                row, at = np.nonzero(cos >= np.maximum(least, -2.0)[:, None] - 1e-8)
                dots = np.zeros(len(row))
                for j in range(v.shape[1]):
                    dots += q[lo + row, j] * v[at, j]
                n = size[lo + row] * length[at]
                exact = np.round(np.where(n == 0, 0.0, dots / np.where(n == 0, 1.0, n)), 9)
                bounds = np.searchsorted(row, np.arange(len(cos) + 1)).tolist()
                for r, (a, b) in enumerate(zip(bounds, bounds[1:]), lo):
                    if a < b:
                        scores, docs = np.append(top[r], exact[a:b]), np.append(ids[r], doc[at[a:b]])
                        kept = np.lexsort((docs, -scores))[:k]
                        top[r], ids[r] = scores[kept], docs[kept]
        r, at = np.nonzero(np.isfinite(top))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(r)), pa.array(ids[r, at]).cast(kind), pa.array(top[r, at])], ["qid", "item_id", "cos"])

    kind = pa.int32() if items.schema["item_id"].dataType.typeName() == "integer" else pa.int64()
    types = [f"{c} {f.schema[c].dataType.simpleString()}" for c, f in (("qid", queries), ("item_id", items))]
    return items.select("item_id", F.transform("v", lambda x: x.cast("double")).alias("v")).mapInArrow(best, ", ".join([*types, "cos double"]))


def covariance(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and centred scatter matrix from one aggregation over all rows (dim + dim^2 sums)."""
    long = vectors.select(F.transform("v", lambda x: x.cast("double")).alias("v"))
    sums = [F.sum(F.get("v", F.lit(i))) for i in range(dim)]
    pairs = [F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))) for i in range(dim) for j in range(i, dim)]
    row = long.agg(F.count("*"), F.array(*sums), F.array(*pairs)).first()
    n, s = max(1, row[0]), np.array([x or 0.0 for x in row[1]])
    c = np.zeros((dim, dim))
    c[np.triu_indices(dim)] = [x or 0.0 for x in row[2]]
    c = c + c.T - np.diag(np.diag(c))
    return s / n, c - np.outer(s, s) / n


def principal_axes(scatter: np.ndarray, steps: int = 60) -> np.ndarray:
    """The first two principal axes by power iteration from a fixed start, the second kept orthogonal to the first."""
    d = len(scatter)
    start = np.array([math.sin(a * 12.9898 + 1) * 43758.5453 for a in range(d)])
    start = start - np.floor(start) - 0.5
    axes: list[np.ndarray] = []
    for _ in range(2):
        v = start / (np.linalg.norm(start) or 1)
        for _ in range(steps):
            w = scatter @ v
            for u in axes:
                w = w - (w @ u) * u
            v = w / (np.linalg.norm(w) or 1)
        axes.append(v)
    return np.array(axes)


def pca2(vectors: DataFrame, dim: int, key: str = "vec_id") -> DataFrame:
    """(key, x, y): rows (key, v) centred and projected on the first two principal axes; only dim^2 numbers reach the driver."""
    mean, scatter = covariance(vectors, dim)
    one, two = principal_axes(scatter)

    def project(axis: np.ndarray) -> Column:
        return V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in axis])) - F.lit(float(mean @ axis))

    return vectors.select(key, F.round(project(one), 6).alias("x"), F.round(project(two), 6).alias("y"))


def scatter_scaled(points: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, px, py) into [8, 92], .5 of it where all are equal, y flipped."""
    bounds = points.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))

    def unit(c: str) -> Column:
        return F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 0.5).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))

    return points.crossJoin(F.broadcast(bounds)).select(key, F.round(F.lit(8.0) + unit("x") * 84, 6).alias("px"), F.round(F.lit(92.0) - unit("y") * 84, 6).alias("py"))


def colour_class(text: Column) -> Column:
    """0 to 5 by the hash of the first word."""
    return F.pmod(T.fnv1a(F.coalesce(F.regexp_extract(text, T.wide("\\S+"), 0), F.lit(""))), F.lit(6)).cast("int")
