"""An inverted-file index of vectors by cosine similarity.

Centres come from spherical k-means, whose sums Spark adds up; each row belongs
to the cell of its nearest centre, and cells are partitions of the written
table. A query probes the cells of its nearest centres and meets their rows in
groups of bounded size, each of which sends the best k of each of its queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import one_thread, written, written_path
from . import embed

#: Bytes of centres, which are broadcast; rows of a cell and queries that meet in one group; rows a cell that centres are fitted on.
CENTRE_BYTES, PART, QUERY_PART, FIT_ROWS = 16 << 20, 20_000, 2_000, 256
_CELL = "item_id long, u array<double>, cell int, near double"


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column scaled to length 1; zeros stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _slices(n: int, width: int):
    """Row ranges whose products with `width` columns have about a million cells."""
    step = max(1, (1 << 20) // max(1, width))
    return ((lo, min(n, lo + step)) for lo in range(0, n, step))


def usable(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """(key, v) with a key and a vector of `dim` numbers."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return rows.select(F.col(key).cast("long").alias(key), F.transform("v", lambda x: x.cast("double")).alias("v")).where(F.col(key).isNotNull() & (F.size("v") == dim) & finite)


def fitted_centres(rows: DataFrame, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres of spherical k-means; rows: item_id, v. It starts from the rows with the least seeded hashes, and a round sends dim sums of each cell."""
    order = F.xxhash64(F.lit(seed), "item_id")
    centres = unit_rows(pa.array([r.v for r in rows.where(F.exists("v", lambda x: x != 0)).orderBy(order, "item_id").limit(cells).collect()], pa.list_(pa.float64())))
    spark = rows.sparkSession
    one_thread(spark)

    def sums(shared):
        def work(batches):
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                u = unit_rows(batch.column(0))
                for lo, hi in _slices(len(u), len(c)):
                    at = np.argmax(u[lo:hi] @ c.T, axis=1)
                    np.add.at(total, at, u[lo:hi])
                    n += np.bincount(at, minlength=len(c))
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), _list(total[met])], ["cell", "total"])

        return work

    for _ in range(rounds if len(centres) else 0):
        shared = spark.sparkContext.broadcast(centres)
        parts = rows.select("v").mapInArrow(sums(shared), "cell int, total array<double>")
        new = np.zeros_like(centres)
        for r in parts.select("cell", F.posexplode("total").alias("k", "x")).groupBy("cell", "k").agg(F.sum("x").alias("x")).collect():  # as many numbers as centres have
            new[r.cell, r.k] = r.x
        shared.destroy()
        length = np.linalg.norm(new, axis=1, keepdims=True)
        centres = np.where(length > 0, new / np.where(length == 0, 1.0, length), centres)  # a cell without rows keeps its centre
    return centres


class VectorIndex:
    """Centres in order of their cells, and the folder of the rows, partitioned by cell."""

    def __init__(self, spark: SparkSession, centres: np.ndarray, path: str):
        one_thread(spark)
        self.spark, self.centres, self.path = spark, centres, path

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, cells: int | None = None, rounds: int = 8, seed: int = 0) -> VectorIndex:
        """Index all rows (item_id, v) of `path`, or of a new folder; the root of their number of cells by default.

        Vectors have the length of most; rows without an item_id or with another
        length, nulls or NaN in the vector are left out. Zero vectors have
        cosine 0 to all. Centres are fitted on FIT_ROWS rows a cell, chosen by
        a hash of the id; every row is indexed.
        """
        spark = rows.sparkSession
        lengths = rows.where("item_id is not null and size(v) > 0").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim = lengths.dim if lengths else 1
        good = usable(rows, "item_id", dim)
        n = good.count()
        cells = min(cells or math.isqrt(max(1, n)), max(1, CENTRE_BYTES // (8 * dim)), max(1, n))
        share = FIT_ROWS * cells / max(1, n)
        sample = good if share >= 1 else good.where(F.pmod(F.xxhash64(F.lit(seed + 1), "item_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        index = cls(spark, fitted_centres(written(sample), cells, rounds, seed), path or written_path(spark))
        if not len(index.centres):  # no row, or zeros alone
            index.centres = np.zeros((1, dim))
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(index.centres)], "cell int, centre array<double>").write.parquet(f"{index.path}/centres")
        index._append(good, "errorifexists")
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
        return cls(spark, np.array([r.centre for r in rows]), path)

    def add(self, rows: DataFrame) -> None:
        """Index more rows (item_id, v) in the cells as they are."""
        self._append(usable(rows, "item_id", self.centres.shape[1]), "append")

    def _append(self, good: DataFrame, mode: str) -> None:
        placed = written(good.select("item_id", "v").mapInArrow(self._assign(), _CELL))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        # a cell goes to one task for each PART of its rows
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.ceil(F.col("n") / PART)))
        dealt.repartition("cell", "part").select("item_id", "u", "near", "cell").write.partitionBy("cell").mode(mode).parquet(f"{self.path}/rows")

    def _assign(self):
        shared = self.spark.sparkContext.broadcast(self.centres)

        def work(batches):
            for batch in batches:
                u = unit_rows(batch.column(1))
                for lo, hi in _slices(len(u), len(shared.value)):
                    near = u[lo:hi] @ shared.value.T
                    at = np.argmax(near, axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _list(u[lo:hi]), pa.array(at, pa.int32()), pa.array(near[np.arange(hi - lo), at])], ["item_id", "u", "cell", "near"])

        return work

    def rows(self) -> DataFrame:
        return self.spark.read.schema("item_id long, u array<double>, near double, cell int").parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        """(cell, n, least, zeros): rows, the least cosine to the centre and whether zero vectors are there."""
        zero = F.forall("u", lambda x: x == 0)
        return written(self.rows().groupBy("cell").agg(F.count("*").alias("n"), F.min(F.when(~zero, F.col("near"))).alias("least"), F.max(zero).alias("zeros")))

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """(qid, item_id, cos, rank): the best k of each query (qid, v) among the rows of the `probes` nearest cells, equal cosines by item_id.

        Without `probes` the result is exact: after a first search, the cells
        that may hold something as good as the k-th of a query are probed too
        (a row's angle to the query is its centre's less the cell's radius at
        least). Queries without a qid or with another length of vector are left
        out; qids are distinct.
        """
        queries = written(usable(queries, "qid", self.centres.shape[1]))
        stats = self.cells()
        first = probes or max(1, math.isqrt(len(self.centres)))
        found = self._met(queries.mapInArrow(self._nearest(first), "qid long, u array<double>, cell int"), stats, k)
        if probes is None:
            found = written(found)
            kth = found.groupBy("qid").agg(F.min("cos").alias("least"), F.count("*").alias("n"))
            asked = queries.join(kth, "qid", "left").select("qid", "v", F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least"))
            bounds = {r.cell: (r.least, r.zeros) for r in stats.collect()}  # one row for each centre
            more = self._met(asked.mapInArrow(self._within(first, bounds), "qid long, u array<double>, cell int"), stats, k)
            best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "item_id"))
            found = found.drop("rank").unionByName(more.drop("rank")).withColumn("rank", best).where(F.col("rank") <= k)
        return found.select("qid", "item_id", "cos", "rank")

    def _nearest(self, probes: int):
        shared = self.spark.sparkContext.broadcast(self.centres)

        def work(batches):
            for batch in batches:
                u = unit_rows(batch.column(1))
                for lo, hi in _slices(len(u), len(shared.value)):
                    order = np.argsort(-(u[lo:hi] @ shared.value.T), axis=1, kind="stable")[:, :probes]
                    at = np.repeat(np.arange(lo, hi), order.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _list(u[at]), pa.array(order.ravel(), pa.int32())], ["qid", "u", "cell"])

        return work

    def _within(self, probed: int, bounds: dict):
        """Cells that were not probed and may hold a cosine as high as the query's `least`."""
        known = np.array([c in bounds for c in range(len(self.centres))])
        radius = np.array([math.acos(min(1.0, max(-1.0, bounds[c][0]))) if c in bounds and bounds[c][0] is not None else 0.0 for c in range(len(self.centres))])
        only_zeros = np.array([c in bounds and bounds[c][0] is None for c in range(len(self.centres))])
        zeros = np.array([c in bounds and bool(bounds[c][1]) for c in range(len(self.centres))])
        shared = self.spark.sparkContext.broadcast((self.centres, known, radius, only_zeros, zeros))

        def work(batches):
            centres, known, radius, only_zeros, zeros = shared.value
            for batch in batches:
                u, least = unit_rows(batch.column(1)), batch.column(2).to_numpy()
                for lo, hi in _slices(len(u), len(centres)):
                    near = u[lo:hi] @ centres.T
                    bound = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - radius))
                    bound[:, only_zeros] = -2.0
                    bound[:, zeros] = np.maximum(bound[:, zeros], 0.0)
                    bound[~u[lo:hi].any(axis=1)] = 0.0
                    open_ = (bound >= least[lo:hi, None] - 1e-8) & known
                    np.put_along_axis(open_, np.argsort(-near, axis=1, kind="stable")[:, :probed], False, axis=1)
                    at, cell = np.nonzero(open_)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + lo)), _list(u[at + lo]), pa.array(cell, pa.int32())], ["qid", "u", "cell"])

        return work

    def _met(self, probing: DataFrame, stats: DataFrame, k: int) -> DataFrame:
        """The best k rows of the probed cells for each query; probing: qid, u, cell."""
        probing = written(probing)
        width = F.col("n") / PART
        plan = F.broadcast(written(probing.groupBy("cell").agg(F.count("*").alias("m")).join(F.broadcast(stats), "cell").select("cell", F.ceil(width).cast("int").alias("parts"), F.ceil(F.col("m") / QUERY_PART).cast("int").alias("query_parts"))).where("parts > 0"))  # one row for each centre; the filter has Spark read the partitions of probed cells alone
        left = probing.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("qid"), "query_parts").cast("int").alias("query_part"), "qid", "u")
        right = self.rows().join(plan, "cell").select("cell", F.pmod(F.xxhash64("item_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"), "item_id", "u")

        def meet(q: pa.Table, items: pa.Table) -> pa.Table:
            out: list[list] = [[], [], []]
            if q.num_rows and items.num_rows:
                items = items.sort_by("item_id").combine_chunks()
                u = items["u"].chunk(0).flatten().to_numpy().reshape(items.num_rows, -1)
                q = q.combine_chunks()
                asked = q["u"].chunk(0).flatten().to_numpy().reshape(q.num_rows, -1)
                for lo, hi in _slices(len(asked), len(u)):
                    cos = np.round(asked[lo:hi] @ u.T, 9)
                    floor = -np.partition(-cos, min(k, len(u)) - 1, axis=1)[:, min(k, len(u)) - 1]
                    at, item = np.nonzero(cos >= floor[:, None])
                    order = np.lexsort((item, -cos[at, item], at))
                    at, item = at[order], item[order]
                    best = np.arange(len(at)) - np.searchsorted(at, at, "left") < k
                    out[0].append(q["qid"].to_numpy()[lo + at[best]])
                    out[1].append(items["item_id"].to_numpy()[item[best]])
                    out[2].append(cos[at[best], item[best]])
            return pa.table([pa.array(np.concatenate(x or [np.zeros(0)]), t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], ["qid", "item_id", "cos"])

        keys = ("cell", "part", "query_part")
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "qid long, item_id long, cos double")
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "item_id"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k)

    def probes_for(self, k: int = 5, recall: float = 0.95, sample: int = 200, seed: int = 7) -> int:
        """The number of cells whose probing finds this share of the true neighbours of `sample` indexed rows, chosen by a hash."""
        rows = self.rows()
        asked = written(rows.orderBy(F.xxhash64(F.lit(seed), "item_id"), "item_id").limit(sample).select(F.col("item_id").alias("qid"), F.col("u").alias("v")).dropDuplicates(["qid"]))
        true = embed.nearest(asked, rows.select("item_id", F.col("u").alias("v")), k)
        cells = rows.select("item_id", "cell").join(F.broadcast(true.select("qid", "item_id")), "item_id").join(F.broadcast(asked), "qid").select("cell", "v").collect()  # sample * k rows
        if not cells:
            return 1
        near = unit_rows(pa.array([r.v for r in cells], pa.list_(pa.float64()))) @ self.centres.T
        place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)[np.arange(len(cells)), [r.cell for r in cells]]
        return int(np.sort(place)[min(len(place) - 1, math.ceil(recall * len(place)) - 1)]) + 1


def recall_at(found: DataFrame, true: DataFrame) -> DataFrame:
    """(queries, pairs, recall): the share of the true pairs (qid, item_id) that were found."""
    hits = true.select("qid", "item_id").join(found.select("qid", "item_id", F.lit(1).alias("hit")), ["qid", "item_id"], "left")
    return hits.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("pairs"), F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0)).alias("recall"))
