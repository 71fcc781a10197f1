"""Retrieval metrics, answer verdicts and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# --- fixed values: patterns and constants of verdicts and estimates ---
DEICTIC_SHORT = "^(?:これ|それ|その|この|あの|同じ|当該|前者|後者|上記|下記|前述|また[、，]|なお[、，]|一方[、，]|σ|τ|式\\(|図[0-9０-９]|表[0-9０-９])"
DEICTIC = DEICTIC_SHORT.replace("|σ", "|さらに|すなわち|σ")
LEAST_CHARS, LEAST_JAPANESE, HEAD_CHARS, TAIL_CHARS = 20, 0.5, 30, 12
FINAL = "(。|である|です。|だ。|をいう|た。|る。)"
TARGETS = {"Agent": 0.78, "Prompt": 0.85, "Tool": 0.81}
HALLMARKS = {
    "definition": "(である|です。|だ。|をいう|のこと|を指す|と呼ば|と定義|を意味|といい|機械要素|装置|とは)",
    "purpose": "(目的|ため|ねらい|役割|用途|機能|防止|を防)",
    "why": "(ため|から|ので|理由|原因|による|起因|生じ|により)",
    "features": "(特徴|利点|長所|短所|性質|優れ|劣る|向く|適する|やすい|にくい|耐食|耐熱|耐摩耗|強度|硬|軽|安価|高い|大きい|小さい|小さく|滑らか|抑え|生じ|できる)",
    "compare": "(に比べ|に対し|一方|より|違い|異な|大きく|小さく|簡単)",
    "howto": "(まず|次に|手順|①|②|決め|求め|選び|に基づ|によって|から|＝|=|の式|係数)",
}


def precision_recall(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(qid, p, r) of each judged query; hits: qid, doc_id, rank; qrels: qid, doc_id, distinct."""
    got = hits.where(F.col("rank") <= k)
    relevant = qrels.groupBy("qid").agg(F.count("*").alias("n_rel"))
    counts = got.join(qrels.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("*").alias("n_ret"), F.sum(F.coalesce("hit", F.lit(0))).alias("n_hit"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("double")
    return relevant.join(counts, "qid", "left").select("qid", F.coalesce(hit / F.col("n_ret"), F.lit(0.0)).alias("p"), (hit / F.col("n_rel")).alias("r"))


def macro_scores(per_query: DataFrame) -> DataFrame:
    """Means over queries, and the F1 of the means."""
    p, r = F.coalesce(F.avg("p"), F.lit(0.0)), F.coalesce(F.avg("r"), F.lit(0.0))
    means = per_query.agg(p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return means.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def recall_mrr(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank at 10 over targets (qid, doc_id)."""
    ranks = targets.join(hits.where("rank <= 10").select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    at = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}")
    return ranks.agg(F.count("*").alias("n"), at(1), at(5), at(10), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr_10"))


def hallucination_rate(sentences: DataFrame) -> DataFrame:
    return sentences.agg(F.round(F.coalesce(F.avg(F.col("flagged").cast("double")), F.lit(0.0)), 6).alias("rate"))


def estimates(k: Column, n: Column) -> Column:
    """Latency, tokens and cost by formula; never measured."""
    prompt, completion = n * 18 + k * 24 + 32, k * 16 + 48
    return F.struct((40 + n * 6 + k * 12).alias("latency_ms"), prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.round(prompt / 1000 * 0.003 + completion / 1000 * 0.015, 9).alias("cost_usd"))


def target_estimates(spark, k: int, n: int) -> DataFrame:
    rows = spark.createDataFrame([(t, p) for t, p in TARGETS.items()], "target string, precision double").withColumn("recall", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("precision") - 0.06)), 6))
    e = estimates(F.lit(max(1, k or 3)), F.lit(n))
    return rows.select("target", "precision", "recall", F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 6).alias("f1"), (e["latency_ms"] + 60).alias("latency_ms"), F.round(e["cost_usd"] * 1.5, 9).alias("cost_usd"))


def readability(text: Column) -> Column:
    """The first reason why an answer doesn't read well, or ok."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t == "", "empty").when(F.length(T.sub(t, "[\\s①-⑳]", "")) < LEAST_CHARS, "short").when(t.rlike(DEICTIC), "deictic").when(T.japanese_ratio(t) < LEAST_JAPANESE, "low_jp")
        .when(T.unbalanced(t), "parens").when(F.substring(t, 1, HEAD_CHARS).rlike("[＝∫∑Σ∏√]"), "math").when(~F.right(t, F.lit(TAIL_CHARS)).rlike(FINAL), "nonfinal").otherwise("ok")
    )


def long_tail_readability(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t == "", "empty").when(F.length(T.sub(t, "[\\s①-⑳]", "")) < LEAST_CHARS, "short").when(t.rlike(DEICTIC_SHORT), "deictic").when(T.japanese_ratio(t) < LEAST_JAPANESE, "low_jp")
        .when(T.unbalanced(t), "parens").when(~T.strip(t).rlike("[。．！？]$"), "nonfinal").otherwise("ok")
    )


def verdict_histogram(answers: DataFrame, verdict: Column) -> DataFrame:
    return answers.groupBy(verdict.alias("reason")).agg(F.count("*").alias("n"))


def contains_any(text: Column, expected: Column) -> Column:
    return F.exists(expected, lambda x: F.contains(F.coalesce(text, F.lit("")), x))


def intent_hallmark(intent: Column, answer: Column) -> Column:
    """Whether an answer has the mark of its intent."""
    listed = (F.regexp_count(answer, F.lit("[・、，]")) >= 2) | answer.rlike("(種類|大別|分けら|に分類|などがある|に分かれ)")
    out = F.when(intent == "list", listed)
    for name, pattern in HALLMARKS.items():
        out = out.when(intent == name, answer.rlike(pattern))
    return out.otherwise(True)


def answer_score(answered: Column, on_topic: Column, clean: Column, intent_fit: Column, informative: Column) -> Column:
    parts = ((answered, 20), (on_topic, 25), (clean, 10), (intent_fit, 30), (informative, 15))
    return sum((F.when(c, w).otherwise(0) for c, w in parts), F.lit(0))


def list_fragments(answer: Column) -> Column:
    """(items, fragments) of a list answer: items that begin like the tail of a word."""
    body = F.regexp_replace(F.coalesce(answer, F.lit("")), "^[^：:]*[：:]", "")
    items = F.filter(F.transform(F.split(body, "[・、，]"), lambda x: T.strip(x)), lambda x: x != "")
    bad = F.filter(items, lambda x: x.rlike("^[ぁ-ん]{1,2}[ァ-ヶ]{2,}") | x.rlike("^[ァィゥェォッャュョヮぁぃぅぇぉっゃゅょゎ]"))
    return F.struct(F.size(items).alias("items"), F.size(bad).alias("fragments"))
