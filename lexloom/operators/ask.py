"""From a question to an answer in one plan: intent, topic words, retrieval, choice of sentences, or a recalled answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import intent_hallmark
from .feedback import not_blocked
from .index import CorpusIndex
from .neural_lm import NeuralLM, sequence_scores
from .retrieve import bm25_top, query_terms

# --- fixed values: marks of question intents in the order they are tried, words that say nothing of a topic, connectives ---
INTENTS = (
    ("list", "種類|分類|挙げ|列挙|どんなもの|一覧"),
    ("compare", "違い|比較|差異|相違"),
    ("why", "なぜ|どうして|理由|原因|要因"),
    ("purpose", "役割|目的|用途|機能|ねらい"),
    ("features", "特徴|利点|欠点|長所|短所|性質|特性"),
    ("howto", "手順|方法|やり方|[しめりえけせて]方|どのように|どう(設計|決め|選|し)"),
    ("definition", "とは|何ですか|何か|意味|定義"),
)
FILLERS = "同士|どうし|同様|自体|自身|全体|以上|以下|以外|以内|程度|前後|双方|両者|場合|一覧|注意点|などの?|における|について|うまく"
ASKED = "原因 理由 特徴 違い 種類 分類 役割 目的 用途 方法 手順 比較 関係 問題 特性 性質 対策 何".split()
KANA_WORDS = "はめあい すきまばめ しまりばめ はすば ねじ ばね".split()
CONNECTIVES = "^(?:ところで|もちろん|やはり|とくに|ともに|もし|でも|のち|はじめ|にもかかわらず)"
NONE = "該当なし"
ENOUGH = 100
# --- end of fixed values ---


def classify_intent(question: Column) -> Column:
    """The first intent whose mark a question has, else default."""
    q, out = F.coalesce(question, F.lit("")), None
    for name, marks in INTENTS:
        out = (F.when if out is None else out.when)(T.has(q, marks), name)
    return out.otherwise("default")


def topic_terms(question: Column) -> Column:
    """Distinct topic words of a question, without fillers, leading quantifiers, particles and words of asking.

    A lone kanji counts where a particle, a blank or the end follows. If only
    words of asking are left, they stay.
    """
    bare = T.sub(F.coalesce(question, F.lit("")), FILLERS, " ")
    runs = F.regexp_extract_all(bare, F.lit("|".join(KANA_WORDS) + "|[一-鿿々]{2,}|[一-鿿](?=[のがをはとにで 、。？?]|$)|[ァ-ヶー]{2,}|[A-Za-z][A-Za-z0-9\\-]+"), F.lit(0))
    found = F.array_distinct(F.transform(runs, lambda x: T.sub(x, "^[各全両諸](?=[一-鿿]{2})", "")))
    return T.bind(found, lambda f: T.bind(F.filter(f, lambda x: ~x.isin(ASKED + T.GENERIC_WORDS)), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(f)))


def ask_junk(sentence: Column) -> Column:
    """Junk as in cleaning, but a sentence may begin with a connective; a torn verb before a particle is junk too."""
    s = F.when(T.has(sentence, CONNECTIVES), F.concat(F.lit("この場合、"), sentence)).otherwise(sentence)
    return T.junk_sentence(s) | T.has(sentence, "るた[をがはに]")


def answers(index: CorpusIndex, docs: DataFrame, queries: DataFrame, k: int = 5, boosts: DataFrame | None = None, blocked: DataFrame | None = None, recalled: DataFrame | None = None, junk=ask_junk, model: NeuralLM | None = None) -> DataFrame:
    """(qid, intent, text, source, weak) for each of the queries (qid, query).

    A recalled answer (qid, text) wins. Else sentences of the k best documents
    that are no junk and not blocked are ordered by whether they have the mark
    of the intent, by the distinct terms they share with the question, then by
    rank and place (with a model, by their mean log probability before these),
    and taken until ENOUGH characters stand; without any the answer is NONE and
    weak.
    """
    asked = queries.select("qid", "query", classify_intent(F.col("query")).alias("intent"))
    hits = bm25_top(index, queries, k, boosts).select("qid", "doc_id", "rank")
    sents = hits.join(docs.select("doc_id", "text"), "doc_id").select("qid", "doc_id", "rank", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence")).where(~junk(F.col("sentence")))
    if blocked is not None:
        signed = sents.join(asked.select("qid", T.signature(F.col("query")).alias("sig")), "qid")
        sents = not_blocked(signed, blocked).drop("sig")
    wanted = query_terms(queries).groupBy("qid").agg(F.collect_set("term").alias("wanted"))  # of one question
    scored = sents.join(wanted, "qid").join(asked.select("qid", "intent"), "qid")
    scored = scored.withColumn("overlap", F.size(F.array_intersect(T.terms(F.col("sentence")), F.col("wanted")))).where("overlap > 0")
    confidence = []
    if model is not None:
        likely = sequence_scores(model, scored.select("qid", "doc_id", "pos", F.col("sentence").alias("text")), "qid", "doc_id", "pos")
        scored = scored.join(likely, ["qid", "doc_id", "pos"]).withColumn("confidence", F.round(F.col("log_prob") / F.greatest("n", F.lit(1)), 9))
        confidence = [F.desc("confidence")]
    order = Window.partitionBy("qid").orderBy(F.desc(intent_hallmark(F.col("intent"), F.col("sentence"))), F.desc("overlap"), *confidence, "rank", "pos")
    before = F.coalesce(F.sum(F.length("sentence")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = scored.select("qid", "sentence", F.row_number().over(order).alias("n"), before.alias("before")).where(F.col("before") < ENOUGH)
    made = picked.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ").alias("made"))
    out = asked.join(made, "qid", "left")
    out = out.join(recalled.select("qid", F.col("text").alias("known")), "qid", "left") if recalled is not None else out.withColumn("known", F.lit(None).cast("string"))
    source = F.when(F.col("known").isNotNull(), "recall").when(F.col("made").isNotNull(), "kb").otherwise("none")
    return out.select("qid", "intent", F.coalesce("known", "made", F.lit(NONE)).alias("text"), source.alias("source"), (source == "none").alias("weak"))
