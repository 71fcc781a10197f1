"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component.

    Each round joins every node's neighbours with the smallest of them; edges
    become stars in a number of rounds that grows with the logarithm of the
    longest path. Every round is written to the shared folder. Minima and
    distinct edges combine before they are shuffled, so a node with very many
    neighbours costs one row for each of them and no more.
    """
    e = textkit.saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most):
        both = e.select(F.col("a").alias("n"), F.col("b").alias("o")).union(e.select(F.col("b").alias("n"), F.col("a").alias("o")))
        low = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
        large = both.where("o > n").join(low, "n").select(F.col("o").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        old, new = e, textkit.saved(small)
        textkit.discard(old)
        # a star forest: no node is both a centre and a leaf, and no leaf has two centres
        many = new.groupBy("a").count().where("count > 1").limit(1).count()
        if not many and not new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            e = new
            break
        e = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
