"""Diversity reranking, context assembly, and checks of an answer against its context."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .index import DIGITS

#: Most candidates of one query; the greedy choice is quadratic in them.
CANDIDATES = 50


def pair_cosines(vectors: DataFrame, group: str = "qid") -> DataFrame:
    """(group, a, b, cos) of unequal items that share a term inside a group; vectors: group, doc_id, term, w."""
    norms = vectors.groupBy(group, "doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    a = vectors.select(group, "term", F.col("doc_id").alias("a"), F.col("w").alias("wa"))
    b = vectors.select(group, "term", F.col("doc_id").alias("b"), F.col("w").alias("wb"))
    dots = a.join(b, [group, "term"]).where("a < b").groupBy(group, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.select(group, F.col("doc_id").alias("a"), F.col("n").alias("na")), norms.select(group, F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    return dots.join(na, [group, "a"]).join(nb, [group, "b"]).select(group, "a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), DIGITS).alias("cos"))


def mmr(hits: DataFrame, pairs: DataFrame, lam: float = 0.7, k: int | None = None) -> DataFrame:
    """Greedy maximal marginal relevance within each query: qid, doc_id, score, mmr, rank.

    hits: qid, doc_id, score, rank, CANDIDATES at most for a query (enforced by
    an error, not by a cut); ties go to the earliest candidate.
    """
    near = pairs.select("qid", F.col("a").alias("doc_id"), F.struct(F.col("b").alias("other"), "cos").alias("x")).union(pairs.select("qid", F.col("b").alias("doc_id"), F.struct(F.col("a").alias("other"), "cos").alias("x")))
    rows = hits.join(near.groupBy("qid", "doc_id").agg(F.collect_list("x").alias("near")), ["qid", "doc_id"], "left").select("qid", "doc_id", "score", "rank", "near")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > CANDIDATES:
            raise ValueError(f"{len(rows)} candidates for one query; at most {CANDIDATES}")
        rows = rows.sort_values("rank")
        similar = {(r.doc_id, x["other"]): x["cos"] for r in rows.itertuples() for x in (r.near if r.near is not None else ())}
        pool, chosen = list(rows.itertuples()), []
        while pool and len(chosen) < (k or len(rows)):
            best, value = None, -math.inf
            for c in pool:
                s = lam * c.score - (1 - lam) * max((similar.get((c.doc_id, o.doc_id), 0.0) for o, _ in chosen), default=0.0)
                if s > value:
                    best, value = c, s
            chosen.append((best, value))
            pool.remove(best)
        return pd.DataFrame([(c.qid, c.doc_id, c.score, v, n) for n, (c, v) in enumerate(chosen, 1)], columns=["qid", "doc_id", "score", "mmr", "rank"])

    return rows.groupBy("qid").applyInPandas(pick, "qid long, doc_id long, score double, mmr double, rank int")


def build_context(hits: DataFrame) -> DataFrame:
    """(qid, context): `[i] text` of the hits in rank order, between blank lines; hits: qid, rank, text."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), T.strip(h["text"]))), "\n\n").alias("context"))


def fill_template(context, query, template: str):
    """The first {context}, then the first {query}, replaced literally."""
    before, _, after = template.partition("{context}")
    out = F.concat(F.lit(before), context, F.lit(after)) if "{context}" in template else F.lit(template)
    at = F.locate("{query}", out)
    return F.when(at == 0, out).otherwise(F.concat(F.substr(out, F.lit(1), at - 1), F.coalesce(query, F.lit("")), F.substr(out, at + 7)))


def groundedness(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """For each sentence: id, pos, sentence, supported, total, ratio, flagged; answers: id, answer; contexts: id, context.

    Terms are counted with repeats; a sentence without terms has ratio 1. An
    answer and its context meet once, by id, and are compared in the row; an
    id has one context.
    """
    known = contexts.select("id", "context")
    sents = answers.join(known, "id", "left").select("id", F.array_distinct(T.terms(F.coalesce("context", F.lit("")))).alias("known"), T.sentences(F.coalesce("answer", F.lit(""))).alias("sentences"))

    def checked(sentence, known):
        held = lambda t: T.bind(F.array_intersect(t, known), lambda hit: F.size(F.filter(t, lambda x: F.array_contains(hit, x))))
        return T.bind(T.terms(sentence), lambda t: F.struct(sentence.alias("sentence"), held(t).cast("long").alias("supported"), F.size(t).cast("long").alias("total")))

    rows = sents.select("id", F.posexplode(T.bind(F.col("known"), lambda k: F.transform(F.col("sentences"), lambda s: checked(s, k)))).alias("pos", "s")).select("id", "pos", "s.*")
    ratio = F.when(F.col("total") == 0, 1.0).otherwise(F.col("supported").cast("double") / F.col("total").cast("double"))
    return rows.select("id", "pos", "sentence", "supported", "total", F.round(ratio, DIGITS).alias("ratio"), (ratio < 0.5).alias("flagged"))


def leading_sentences(docs: DataFrame, limit: int = 110) -> DataFrame:
    """(doc_id, extract): sentences while what stands before them is shorter than `limit`; 140 characters if there is none."""
    sents = docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))
    before = F.coalesce(F.sum(F.length("sentence")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sents.withColumn("before", before).where(F.col("before") < limit).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), "").alias("extract"))
    return docs.join(kept, "doc_id", "left").select("doc_id", F.coalesce("extract", F.substring(F.coalesce("text", F.lit("")), 1, 140)).alias("extract"))


def prompt(query, contexts):
    """System and user messages with the first four contexts labelled 【資料i】."""
    labelled = F.transform(F.slice(contexts, 1, 4), lambda c, i: F.concat(F.lit("【資料"), (i + 1).cast("string"), F.lit("】"), c))
    return F.concat(F.array_join(labelled, "\n"), F.lit("\n\n質問: "), query)


def unfaithful_runs(answer, context):
    """Content runs of an answer that its context does not contain."""
    return F.filter(F.regexp_extract_all(answer, F.lit("[一-鿿]{2,}|[ァ-ヶー]{2,}|[A-Za-z0-9]{2,}"), F.lit(0)), lambda r: ~F.contains(context, r))
