"""State that grades build up: an append-only event log and tables derived from it.

Events: ts, q, text, source, compose (array), label ('good' or 'bad'). Folds
run in the order of ts inside an aggregation, one row for each term or
question, so histories of different keys never meet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values ---
MAX_TERM, BASE_TERM, REWARD, DECAY = 3.0, 1.0, 0.5, 0.5
MAX_ACCEPTED, MAX_REJECTED, MAX_EVENTS, MAX_BLOCKED = 200, 200, 500, 50
RECALL_MIN_COS = 0.9
# --- end of fixed values ---
#: Events of a span of time that a term's steps are composed in.
SPAN = 50_000


def latest(rows: DataFrame, n: int, order: str = "ts") -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n)


def event_log(events: DataFrame) -> DataFrame:
    return latest(events.select("ts", "q", "label"), MAX_EVENTS)


def _clamp(x, low, high):
    return F.greatest(low, F.least(high, x))


def clamped_fold(steps):
    """An ordered array of steps (add, low, high), each a function w -> max(low, min(high, w + add)), as one step of the same kind."""
    none = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    return F.aggregate(steps, none, lambda f, g: F.struct((f["add"] + g["add"]).alias("add"), _clamp(f["low"] + g["add"], g["low"], g["high"]).alias("low"), _clamp(f["high"] + g["add"], g["low"], g["high"]).alias("high")))


def in_order(key: str, *fields: str):
    """The structs of a group, sorted by a key, without it."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key, *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields)))


def term_weights(events: DataFrame, text: str = "q", span: int = SPAN) -> DataFrame:
    """(term, w): a good grade rewards the distinct terms of the question, a bad one takes as much away.

    A step is a clamped sum, and such functions compose: the events are cut
    into spans of time of about `span` events, a term's steps are composed
    inside each span, and the spans then in order. No row holds more than a
    span's steps of a term, however frequent it is.
    """
    add = F.when(F.col("label") == "good", F.lit(REWARD)).otherwise(F.lit(-DECAY))
    spans = -(-events.count() // span)
    cuts = (events.agg(F.percentile_approx(F.col("ts").cast("double"), [k / spans for k in range(1, spans)], 10 * spans)).first()[0] or []) if spans > 1 else []
    at = sum((F.when(F.col("ts").cast("double") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = events.select("ts", at.alias("span"), add.alias("add"), F.lit(BASE_TERM).alias("low"), F.lit(MAX_TERM).alias("high"), F.explode(F.array_distinct(T.terms(F.coalesce(text, F.lit(""))))).alias("term"))
    one = rows.groupBy("term", "span").agg(clamped_fold(in_order("ts", "add", "low", "high")).alias("f")).select("term", "span", "f.*")
    return one.groupBy("term").agg(clamped_fold(in_order("span", "add", "low", "high")).alias("f")).select("term", _clamp(F.lit(BASE_TERM) + F.col("f.add"), F.col("f.low"), F.col("f.high")).alias("w"))


def boosts(weights: DataFrame) -> DataFrame:
    """(term, boost) of the terms that weigh more than 1."""
    return weights.where(F.col("w") > BASE_TERM).select("term", F.col("w").alias("boost"))


def accepted_pool(events: DataFrame) -> DataFrame:
    return latest(events.where("label = 'good' and text <> ''").select("ts", "q", "text", "source"), MAX_ACCEPTED)


def rejected_pool(events: DataFrame) -> DataFrame:
    return latest(events.where("label = 'bad' and text <> ''").select("ts", "q", "text", "source"), MAX_REJECTED)


def blocked_parts() -> Column:
    """What a rejected answer blocks: its text, its sentences and parts, stripped, in this order."""
    text = F.coalesce("text", F.lit(""))
    parts = F.concat(F.array(text), T.feedback_sentences(text), F.coalesce("compose", F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(parts, T.strip), lambda x: x != ""))


def blocked_step(blocked: list[str], parts: list[str]) -> list[str]:
    """The set after one more answer: parts that are not there come last, and the last MAX_BLOCKED stay."""
    known = set(blocked)
    return [*blocked, *(p for p in parts if p not in known)][-MAX_BLOCKED:]


def blocked_sets(events: DataFrame) -> DataFrame:
    """(sig, blocked): what each question's rejected answers block, in the order of ts (equal ones by parts).

    A part that has fallen out of the set comes back with a later answer, so a
    question's answers fold one after the other; they pass through a task in
    order, and it holds one set and one batch of rows at a time.
    """

    def fold(batches):
        sig, blocked, started = None, [], False
        for batch in batches:
            out = []
            for key, parts in zip(batch["sig"], batch["parts"]):
                if started and key != sig:
                    out.append((sig, blocked))
                    blocked = []
                sig, started = key, True
                blocked = blocked_step(blocked, list(parts))
            yield pd.DataFrame(out, columns=["sig", "blocked"])
        if started:
            yield pd.DataFrame([(sig, blocked)], columns=["sig", "blocked"])

    rows = events.where("label = 'bad'").select("ts", T.signature(F.col("q")).alias("sig"), blocked_parts().alias("parts"))
    folded = rows.repartition("sig").sortWithinPartitions("sig", "ts", "parts").mapInPandas(fold, "sig string, blocked array<string>")
    return folded.where(F.size("blocked") > 0)


def not_blocked(candidates: DataFrame, blocked: DataFrame) -> DataFrame:
    """Candidates (sig, sentence, ...) less those that the question's set blocks."""
    return candidates.join(blocked.select("sig", F.explode("blocked").alias("sentence")), ["sig", "sentence"], "left_anti")


def recall_answer(accepted: DataFrame, queries: DataFrame, min_cos: float = RECALL_MIN_COS) -> DataFrame:
    """(qid, text, cos): the accepted answer to the most similar question, the latest of equals; needs `v` embeddings on both sides. Accepted answers, few by MAX_ACCEPTED, are broadcast."""
    from ..functions import vectors as V

    scored = queries.select("qid", F.col("v").alias("qv")).crossJoin(F.broadcast(accepted)).withColumn("cos", F.round(V.cosine(F.col("v"), F.col("qv")), 9)).where(F.col("cos") >= min_cos)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), F.desc("ts")))
    return scored.withColumn("rank", rank).where("rank = 1").select("qid", "text", "cos")


def stats(events: DataFrame) -> DataFrame:
    return events.agg(F.sum((F.col("label") == "good").cast("long")).alias("good"), F.sum((F.col("label") == "bad").cast("long")).alias("bad"), F.count("*").alias("events"), F.countDistinct(F.when(F.col("label") == "bad", T.signature(F.col("q")))).alias("blocked_questions"))


def top_weights(weights: DataFrame, n: int = 12) -> DataFrame:
    return boosts(weights).orderBy(F.desc("boost"), "term").limit(n).select("term", F.round("boost", 2).alias("w"))
