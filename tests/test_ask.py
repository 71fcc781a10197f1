"""Intents, topic words and junk of questions on the labelled cases, and answers end to end."""

import re

import pytest
from pyspark.sql import functions as F

from lexloom.operators import ask, feedback, index

INTENTS = {
    "definition": "歯車とは何ですか 軸受とは何か 機械とは何か 材料力学とはどういうものですか 応力集中とは 熱伝達率とは 疲労破壊とは何か ポンプとは何ですか 溶接とは 歯車とは何か 軸受とは ねじとは何か",
    "list": "軸受の種類を教えてください 歯車の種類 ねじの種類にはどんなものがありますか 熱処理の方法にはどんなものがありますか ポンプの種類 歯車の分類 鋼の種類を挙げよ",
    "purpose": "ねじの役割は何ですか 潤滑の目的は何ですか 軸受の役割 減速機の役割は キーの役割は何ですか 潤滑の用途 ボルトの機能は",
    "why": "疲労破壊はなぜ起こるのですか 応力集中はなぜ問題になるのか ボルトが緩む理由 腐食はなぜ起こるのか なぜ焼入れをするのか 腐食が起こる原因",
    "features": "ばねの特徴を教えて はすば歯車の特徴 ステンレス鋼の特徴は 玉軸受の利点 すべり軸受の長所 アルミニウムの性質",
    "compare": "すべり軸受と転がり軸受の違い 平歯車とはすば歯車の違いは何ですか 鋳造と鍛造の違い すべり軸受と転がり軸受の比較",
    "howto": "歯車の強度はどう設計しますか 軸の直径はどのように決めますか 歯車の設計手順 軸受の選定方法 ねじの締め方 焼入れのやり方",
    "default": "強度 振動 エンジン",
}
TOPICS = [
    ("歯車同士の噛み合いが悪い原因", "歯車"), ("軸同士の関係", "軸"), ("鋼同士の関係", "鋼"), ("弁自体の問題", "弁"), ("鋼自体の特性", "鋼"), ("歯車全体の構造", "歯車"), ("軸受以上の強度", "軸受"), ("応力程度の精度", "応力"), ("材料の場合の対策", "材料"), ("全歯車の一覧", "歯車"), ("各軸受の特徴", "軸受"),
    ("各種の鋼", "鋼"), ("ねじがうまく動かない理由", "ねじ"), ("ねじにおける課題", "ねじ"), ("ねじなどの種類", "ねじ"), ("歯車のかみ合いが悪い原因", "歯車"), ("はめあいとは", "はめあい"), ("すきまばめとしまりばめの違い", "すきまばめ"), ("はすば歯車の特徴", "歯車"), ("全長の測定", "全長"), ("主軸の設計", "主軸"),
]
BANNED = re.compile("同士|どうし|同様|自体|自身|全体|以上|以下|以外|以内|程度|前後|双方|両者|場合|一覧|注意点|などの?|における|について|うまく|^[各全両諸](?=[一-鿿]{2})|^[のがをにへでと]")
SENTENCES = [
    ("安全率を設けるのは、荷重のばらつきに備えて余裕を確保するためです。", False), ("応力集中を緩和するために、すみ肉を丸めて曲率半径を大きくする。", False), ("潤滑油を選ぶためには、粘度・使用温度・荷重条件を考慮する必要がある。", False), ("ところで軸受の寿命は荷重と回転数から見積もることができる。", False),
    ("もちろん安全率は荷重条件に応じて適切に設定する必要がある。", False), ("やはり強度設計では応力集中の緩和が重要な要素となる。", False), ("歯車は、回転によって動力を伝える代表的な機械要素である。", False), ("これは実現させるたを並べた異常な断片であり破棄すべき対象である。", True), ("を支える軸受は荷重方向に応じて選定する必要がある断片。", True),
    ("図3・41 応力集中部の形状と曲率半径の関係", True), ("(1) (2) (3) 値 値 値 系列", True),
]


def test_intents(spark):
    rows = [(q, k) for k, qs in INTENTS.items() for q in qs.split()]
    got = spark.createDataFrame(rows, "q string, want string").select("q", "want", ask.classify_intent(F.col("q")).alias("intent")).collect()
    assert [(r.q, r.intent) for r in got if r.intent != r.want] == []


def test_topics(spark):
    for r in spark.createDataFrame(TOPICS, "q string, topic string").select("q", "topic", ask.topic_terms(F.col("q")).alias("terms")).collect():
        assert any(r.topic in t for t in r.terms) and not any(BANNED.search(t) for t in r.terms), r


def test_junk(spark):
    got = spark.createDataFrame(SENTENCES, "s string, junk boolean").select("s", "junk", ask.ask_junk(F.col("s")).alias("got")).collect()
    assert [r.s for r in got if r.got != r.junk] == []


@pytest.fixture(scope="module")
def shelf(spark):
    docs = [(1, "歯車は、回転によって動力を伝える代表的な機械要素である。歯車には平歯車、はすば歯車、かさ歯車などの種類がある。"), (2, "軸受は回転する軸を支える重要な機械要素である。軸受の役割は摩擦を減らすためであり回転を滑らかにする。"), (3, "図3 歯車。短い。"), (4, None)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_answers(spark, shelf):
    asks = spark.createDataFrame([(1, "歯車とは何ですか"), (2, "軸受の役割は"), (3, "zzz"), (4, "歯車の種類"), (5, None)], "qid long, query string")
    index_ = index.CorpusIndex.build(shelf)
    got = {r.qid: r for r in ask.answers(index_, shelf, asks).collect()}
    assert got[1].intent == "definition" and got[1].text.startswith("歯車は、回転によって") and got[1].source == "kb" and not got[1].weak
    assert got[2].intent == "purpose" and "摩擦" in got[2].text.split("。")[0] + got[2].text
    assert got[4].intent == "list" and got[4].text.startswith("歯車には平歯車")
    assert all(got[k].text == ask.NONE and got[k].weak and got[k].source == "none" for k in (3, 5))
    events = spark.createDataFrame([(1, "歯車とは何ですか", got[1].text.split(" ")[0], "kb", [], "bad")], "ts long, q string, text string, source string, compose array<string>, label string")
    second = {r.qid: r for r in ask.answers(index_, shelf, asks, blocked=feedback.blocked_sets(events)).collect()}
    assert not second[1].text.startswith("歯車は、回転によって") and second[2].text == got[2].text
    assert "代表的" not in second[4].text  # questions of the same key terms share what is blocked
    recalled = spark.createDataFrame([(3, "known answer")], "qid long, text string")
    third = {r.qid: r for r in ask.answers(index_, shelf, asks, recalled=recalled).collect()}
    assert (third[3].text, third[3].source, third[3].weak) == ("known answer", "recall", False) and third[1].text == got[1].text
