"""Summaries of conversations and texts; extractive answers; keywords."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .index import CorpusIndex
from .retrieve import query_terms


def frequency_summary(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, summary): the n sentences whose terms are most frequent in the text on average, in text order."""
    sents = docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))
    terms = sents.select("doc_id", "pos", F.explode(T.terms(F.col("sentence"))).alias("term"))
    freq = terms.groupBy("doc_id", "term").agg(F.count("*").alias("f"))
    scored = terms.join(freq, ["doc_id", "term"]).groupBy("doc_id", "pos").agg(F.round(F.avg("f"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))
    best = sents.join(scored, ["doc_id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("rank", rank).where(F.col("rank") <= n)
    return best.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))


def sentence_ranks(terms, rounds: int, damping: float) -> np.ndarray:
    """PageRank of a text's sentences (lists of terms) in the graph of their cosines.

    A round goes through the terms and back, so the work is linear in the
    text's terms; the pairs of sentences are never made.
    """
    n, number = len(terms), {}
    cells = [(k, number.setdefault(t, len(number)), f) for k, ts in enumerate(terms) for t, f in Counter(ts).items()]
    rows, cols, weight = (np.array(x, d) for x, d in zip(zip(*cells) if cells else [()] * 3, (np.int64, np.int64, np.float64)))
    norm = np.sqrt(np.bincount(rows, weight**2, n))
    weight = weight / norm[rows]
    itself = np.bincount(rows, weight**2, n)
    degree = np.bincount(rows, weight * np.bincount(cols, weight, len(number))[cols], n) - itself
    rank = np.ones(n)
    for _ in range(rounds):
        share = np.where(degree > 1e-12, rank / np.maximum(degree, 1e-12), 0.0)
        through = np.bincount(cols, weight * share[rows], len(number))
        rank = 1 - damping + damping * (np.bincount(rows, weight * through[cols], n) - itself * share)
    return rank


def text_rank(docs: DataFrame, n: int = 3, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(doc_id, summary): the n sentences of highest PageRank in each text's graph of term-cosine similarities, in text order; a text without sentences has no row."""
    sents = docs.select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("sentences")).where("size(sentences) > 0")

    def work(batches):
        for batch in batches:
            out = []
            for sentences, terms in zip(batch["sentences"], batch["terms"]):
                rank = np.round(sentence_ranks(list(terms), rounds, damping), 9)
                out.append(" ".join(sentences[k] for k in sorted(np.argsort(-rank, kind="stable")[:n])))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "summary": out})

    return sents.select("doc_id", "sentences", F.transform("sentences", T.terms).alias("terms")).mapInPandas(work, "doc_id long, summary string")


def compress_conversations(turns: DataFrame, n: int = 3) -> DataFrame:
    """(conv_id, before_chars, after_chars, ratio, summary) of conversations (conv_id, turn, text)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(T.strip(F.coalesce("text", F.lit(""))) != "", F.struct("turn", "text")))), lambda x: x["text"]), " ")
    whole = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(text.alias("text"))
    out = whole.join(frequency_summary(whole, n), "doc_id", "left").select(F.col("doc_id").alias("conv_id"), F.length("text").cast("long").alias("before_chars"), F.length(F.coalesce("summary", F.lit(""))).cast("long").alias("after_chars"), F.coalesce("summary", F.lit("")).alias("summary"))
    ratio = F.when(F.col("before_chars") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("after_chars") / F.col("before_chars")))
    return out.select("conv_id", "before_chars", "after_chars", F.round(ratio, 6).alias("ratio"), "summary")


def keywords(index: CorpusIndex, n: int = 5) -> DataFrame:
    """(doc_id, term, w, rank): each document's heaviest TF-IDF terms."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "term"))
    return index.tfidf().withColumn("w", F.round("w", 9)).withColumn("rank", rank).where(F.col("rank") <= n).select("doc_id", "term", "w", "rank")


def extract_answers(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id, answer, overlap): of the best documents, the sentence that shares most distinct terms with the query."""
    sents = hits.select("qid", "doc_id", "rank").join(docs.select("doc_id", "text"), "doc_id").select("qid", "doc_id", "rank", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "answer"))
    words = sents.select("qid", "doc_id", "pos", F.explode(F.array_distinct(T.terms(F.col("answer")))).alias("term"))
    overlap = words.join(query_terms(queries).select("qid", "term"), ["qid", "term"]).groupBy("qid", "doc_id", "pos").agg(F.count("*").alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("overlap"), "rank", "pos"))
    return sents.join(overlap, ["qid", "doc_id", "pos"]).withColumn("best", rank).where("best = 1").select("qid", "doc_id", "answer", "overlap")


def find_in_pages(pages: DataFrame, needle: str) -> DataFrame:
    """(doc_id, page, pos, sentence) of the sentences of pages (doc_id, page, text) that contain a string, whatever the case."""
    sents = pages.select("doc_id", "page", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))
    return sents.where(F.contains(F.lower("sentence"), F.lit(needle.lower())))


def find_in_document(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, pos, sentence) of the sentences that contain a string, whatever the case."""
    sents = docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))
    return sents.where(F.contains(F.lower("sentence"), F.lit(needle.lower())))
