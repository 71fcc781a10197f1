"""Term statistics, weights and the pruned inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

DIGITS = 9


def term_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each term occurrence."""
    return docs.select(F.col(doc), F.explode(T.terms(F.col(text))).alias("term"))


def term_frequencies(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return term_rows(docs, doc, text).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def tfidf_idf(df: Column, n: Column) -> Column:
    return F.log(1 + n.cast("double") / df.cast("double"))


def bm25_idf(df: Column, n: Column) -> Column:
    d, n = df.cast("double"), n.cast("double")
    return F.log(1 + (n - d + F.lit(0.5)) / (d + F.lit(0.5)))


def bm25_weight(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """Of columns, or of numpy arrays of doubles."""
    f, dl = (x.cast("double") if isinstance(x, Column) else x for x in (tf, dl))
    return idf * f * (k1 + 1.0) / (f + float(k1) * ((1.0 - b) + float(b) * dl / avgdl))


@dataclass
class CorpusIndex:
    """tf(doc_id, term, tf), df(term, df), dl(doc_id, dl) and stats(n, avgdl) of a corpus; build once, save, query often. One that is built on the way knows its texts, docs(doc_id, text)."""

    tf: DataFrame
    df: DataFrame
    dl: DataFrame
    stats: DataFrame
    docs: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> CorpusIndex:
        tf = term_frequencies(docs, doc, text).withColumnRenamed(doc, "doc_id")
        lengths = docs.select(F.col(doc).alias("doc_id"), F.size(T.terms(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("dl"))
        stats = lengths.agg(F.count("*").alias("n"), F.when(F.count("*") == 0, 1.0).otherwise(F.sum("dl").cast("double") / F.count("*").cast("double")).alias("avgdl"))
        return cls(tf, document_frequencies(tf), lengths, stats, docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")))

    def save(self, path: str, buckets: int = 64) -> None:
        """Parquet tables; tf is clustered by term so that a query reads few files' row groups."""
        self.tf.repartitionByRange(buckets, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/tf")
        for name in ("df", "dl", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CorpusIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("tf", "df", "dl", "stats")))

    def tfidf(self) -> DataFrame:
        """(doc_id, term, tf, w): raw tf times ln(1 + N / df)."""
        weighted = self.df.crossJoin(F.broadcast(self.stats)).select("term", tfidf_idf(F.col("df"), F.col("n")).alias("idf"))
        return self.tf.join(weighted, "term").select("doc_id", "term", "tf", (F.col("tf").cast("double") * F.col("idf")).alias("w"))

    def bm25(self, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(doc_id, term, tf, df, w): BM25 contributions, ready to be summed."""
        idf = self.df.crossJoin(F.broadcast(self.stats)).select("term", "df", bm25_idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")
        return self.tf.join(self.dl, "doc_id").join(idf, "term").select("doc_id", "term", "tf", "df", bm25_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b).alias("w"))


def pruned_postings(index: CorpusIndex, k: int = 8, df_min: int = 2, df_cap: float = 0.30, k1: float = 1.2, b: float = 0.5) -> DataFrame:
    """(term, doc_id, weight): terms with df_min <= df <= floor(df_cap N), each with its k heaviest documents, 3 decimals."""
    kept = index.df.crossJoin(F.broadcast(index.stats)).where((F.col("df") >= df_min) & (F.col("df") <= F.floor(F.lit(df_cap) * F.col("n"))))
    idf = kept.select("term", bm25_idf(F.col("df"), F.col("n")).alias("idf"), F.greatest(F.lit(1.0), "avgdl").alias("avgdl"))
    weighted = index.tf.join(idf, "term").join(index.dl, "doc_id").select("term", "doc_id", F.round(bm25_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b), DIGITS).alias("w"))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w"), "doc_id"))
    return weighted.withColumn("rank", rank).where(F.col("rank") <= k).select("term", "doc_id", F.round("w", 3).alias("weight"))


def write_index_json(postings: DataFrame, meta: DataFrame, path: str) -> None:
    """The nested form: one JSON line for a term, [[doc, weight], ...], and the titles beside it."""
    nested = postings.groupBy("term").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "doc_id", "weight"))).alias("p"))
    nested.select("term", F.transform("p", lambda x: F.array(x["doc_id"].cast("double"), x["weight"])).alias("post")).write.mode("overwrite").json(f"{path}/post")
    meta.write.mode("overwrite").json(f"{path}/meta")


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("term string, post array<array<double>>").json(f"{path}/post")
    return rows.select("term", F.explode("post").alias("p")).select("term", F.get("p", F.lit(0)).cast("long").alias("doc_id"), F.get("p", F.lit(1)).alias("weight"))
