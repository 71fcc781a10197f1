"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and is written and read again as the next one's docs.

All but the last return the columns of documents. Rows without a doc_id can't
be told apart and leave at the first stage. Rows that share a doc_id go or
stay together. Null and empty texts are rows like others: they get a score,
lose no lines, link with nothing, hold no test item and have no pieces. An
empty table gives an empty table, and empty labels or benchmarks reject
nothing. Columns beside doc_id, text, source and n_chars pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import textkit
from lexloom.llm.decontaminate import leaks
from lexloom.llm.jaccard import jaccard_groups
from lexloom.llm.nbest import segmentations
from lexloom.llm.quality_rank import quality_scores
from lexloom.llm.site_lines import without_shared_lines


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in `gone` (one column, distinct); its size decides how it is joined."""
    return docs.join(textkit.sized(textkit.saved(gone), 16), "doc_id", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality ranking rejects, and rows without a doc_id; without labels of both kinds none is rejected."""
    docs = docs.where("doc_id is not null")
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scores.where("predicted = 0").select("doc_id").distinct())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that many sites share (first copies stay, ties by line number); a document that loses all its words goes, one that had none stays."""
    cleaned = without_shared_lines(docs)
    rows = cleaned.where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return rows.select(*[F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates; rows that share that id all stay."""
    return without(docs, jaccard_groups(docs).where("doc_id <> component_id").select("doc_id").distinct())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold test items; an empty benchmark drops none."""
    return without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentations of what is left, one row for each document."""
    import public_tokenizers

    return segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", pieces)]
#: SQL can't express the learnt score of the first stage or the segmentations of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = textkit.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = textkit.saved(docs)
    return docs
