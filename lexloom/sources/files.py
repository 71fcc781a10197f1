"""File sources and sinks: markdown folders, archives, a key-value folder, an injectable web lookup."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, title) of the numbered markdown files of a folder; the number in the name is the id."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.regexp_extract(F.col("_metadata.file_name"), "^(\\d+)\\.md$", 1).alias("name"), F.col("value").alias("text"))
    return rows.where("name <> ''").select(F.col("name").cast("int").alias("doc_id"), "text", F.trim(F.regexp_extract("text", "(?m)^\\s*#\\s+(.+)\\s*$", 1)).alias("title"))


def write_markdown(docs: DataFrame, folder: str, apply: bool = True) -> int:
    """Write (doc_id, text) as text, one partition folder for each id; with apply=False only count."""
    if apply:
        docs.select(F.lpad(F.col("doc_id").cast("string"), 4, "0").alias("doc"), F.regexp_replace("text", "\\n$", "").alias("text")).write.mode("overwrite").partitionBy("doc").text(folder)
    return docs.count()


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, bytes, content, text) of the stored and deflated members of zip archives; folders and unreadable members are skipped."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for archive, content in zip(batch["path"], batch["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for info in z.infolist():
                    if info.is_dir() or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        continue
                    try:
                        data = z.read(info)
                    except (zipfile.BadZipFile, RuntimeError, EOFError):
                        continue
                    out.append((archive, info.filename, len(data), data, data.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["archive", "path", "bytes", "content", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, path string, bytes long, content binary, text string")


def normalized(text: Column) -> Column:
    """NFKC, which SQL lacks, by an Arrow UDF."""

    @F.pandas_udf(T.StringType())
    def nfkc(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFKC")

    return nfkc(text)


def clean_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) of page texts, NFKC, without bare page numbers and lines that most pages of a document repeat."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split(normalized(F.col("text")), "\n")).alias("pos", "line")).where(~F.trim("line").rlike("^[-–— ]*\\d+[-–— ]*$"))
    counts = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n"))
    often = lines.where(F.trim("line") != "").groupBy("doc_id", "line").agg(F.countDistinct("page").alias("m")).join(counts, "doc_id").where("n >= 3 and m * 2 > n").select("doc_id", "line")
    kept = lines.join(often, ["doc_id", "line"], "left_anti")
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


class KeyValueStore:
    """Small named values kept as parquet; a missing or unreadable key gives the fallback."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def get(self, key: str, fallback=None):
        try:
            row = self.spark.read.parquet(f"{self.folder}/{key}").first()
        except Exception:  # noqa: BLE001  no such key
            return fallback
        return json.loads(row["value"]) if row else fallback

    def set(self, key: str, value) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{key}")


def web_lookup(queries: DataFrame, fetch: Callable[[str], dict | None]) -> DataFrame:
    """(qid, title, extract, url) through a fetcher given by the caller; misses, disambiguations and failures give nulls.

    fetch(term) returns {"title", "extract", "url", "type"} or None. Nothing is
    fetched by this library itself.
    """
    terms = queries.select("qid", X.web_term(F.col("query")).alias("term"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for qid, term in zip(batch["qid"], batch["term"]):
                try:
                    hit = fetch(term) if term else None
                except Exception:  # noqa: BLE001  a failed fetch is a miss
                    hit = None
                good = hit and hit.get("extract") and hit.get("type") != "disambiguation"
                out.append((qid, *((hit.get("title"), hit["extract"].strip(), hit.get("url")) if good else (None, None, None))))
            yield pd.DataFrame(out, columns=["qid", "title", "extract", "url"])

    return terms.mapInPandas(work, "qid long, title string, extract string, url string")


def newest(records: DataFrame, n: int = 20, order: str = "uploaded_at") -> DataFrame:
    return records.orderBy(F.desc(order)).limit(n)
