"""Text functions on worked examples."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names))).first()[0]


@pytest.mark.parametrize("text, want", [("BM25 & TF-IDF: a 歯車は、動力・ABC を伝える", "bm25 tf-idf abc 歯車 車は は動 動力 力・ ・を を伝 伝え える".split()), ("x", []), ("歯", []), ("", [])])
def test_terms(spark, text, want):
    assert one(spark, T.terms, text) == want


@pytest.mark.parametrize("text, want", [("", 2166136261), ("a", 3826002220), ("foobar", 3214735720), ("歯車", 2726001980), ("😀", 3409036472)])
def test_fnv1a(spark, text, want):
    assert one(spark, T.fnv1a, text) == want


def test_sentences(spark):
    assert one(spark, T.sentences, " Up 99.99% today.  Is it?Yes! 歯車。軸 ") == ["Up 99.99% today.", "Is it?", "Yes!", "歯車。", "軸"]
    assert one(spark, T.feedback_sentences, "短い。これは長い文です。Ends. Here") == ["これは長い文です。", "Ends. Here"]
    assert one(spark, T.clean_sentences, "短い。これは十分に長い文です。") == ["これは十分に長い文です。"]


def test_tokens(spark):
    assert one(spark, T.lm_tokens, "it's 歯車。\nx") == ["it's", "歯", "車", "。", "\n", "x"]
    assert one(spark, lambda c: T.detokenize(T.lm_tokens(c)), "the gear 歯車 a b。\nok") == "the gear歯車a b。\nok"
    assert one(spark, T.embedding_tokens, "ab12 歯!") == ["ab", "12", "歯", "!"]
    assert one(spark, T.space_tokens, "a  b") == ["a", "  ", "b"]


def test_key_terms(spark):
    assert one(spark, T.key_terms, "歯車の種類とギヤ、歯車 CAD-1 a") == ["歯車", "ギヤ", "CAD-1"]
    assert one(spark, T.signature, "ギヤと歯車") == "ギヤ|歯車" and one(spark, T.signature, "あ い") == "あい"


def test_cleaners(spark):
    assert one(spark, T.strip_garbage, "ab가c") == "abc"
    assert one(spark, T.clean_inline, "s⁻¹ ⁻¹²・x  y") == "s⁻¹ x y"
    assert one(spark, T.restore_punctuation, "歯車.軸,(図)a.b,c") == "歯車。軸、(図)a.b,c"
    assert one(spark, T.tidy, "、、a、，、b,,c") == "a、b,c"
    assert one(spark, T.clean_line, "## *見出し* ") == "見出し"
    assert one(spark, T.sanitize, "。歯車（図1）は(2)強い ）") == "歯車は強い）"
    assert one(spark, T.normalize_title, "4・1・3 歯車（gear） の強さ") == "歯車の強さ"
    assert one(spark, T.fill_clean, "歯車. 軸（ ）、、末  尾 。") == "歯車。 軸、末 尾。"
    clean = "歯車は動力を伝える機械要素である。"
    for f in (T.strip_garbage, T.clean_inline, T.restore_punctuation, T.tidy, T.sanitize, T.fill_clean):
        assert one(spark, f, clean) == clean


@pytest.mark.parametrize("text, junk", [("歯車は動力を伝える重要な機械要素である。", False), ("歯車は動力を伝える", True), ("短い文。", True), ("表1は歯車の種類と特徴を示している。", True), ("（1）歯車は動力を伝える機械要素である。", True), ("歯車は（動力を伝える重要な機械要素である。", True), ("The gear transmits power to shafts.", True)])
def test_junk(spark, text, junk):
    assert one(spark, T.junk_sentence, text) is junk


def test_predicates(spark):
    assert one(spark, T.formula_signal, "σ") and one(spark, T.formula_signal, "F a") and not one(spark, T.formula_signal, "neering)")
    assert one(spark, T.heading_line, "概要") and not one(spark, T.heading_line, "歯車は動力を伝える機械要素")
    assert one(spark, T.math_line, "x = y + 1") and not one(spark, T.math_line, "歯車は動力を伝える")


@pytest.mark.parametrize("q, wants, term", [("Webで歯車を調べて", True, "歯車"), ("歯車についてググって", True, "歯車について"), ("歯車とは何ですか", False, "歯車")])
def test_web(spark, q, wants, term):
    assert one(spark, T.wants_web, q) is wants
    if wants is False:
        assert one(spark, T.web_term, q) == term


def test_routes(spark):
    assert one(spark, T.query_parameters, "a=1&b=x%20y&a=3&=z&c") == {"a": "3", "b": "x y", "c": ""}
    assert one(spark, lambda c: T.route_parameters(c, "/docs/:id"), "/docs/a%2Fb") == {"id": "a/b"}
    assert one(spark, lambda c: T.route_parameters(c, "/docs/:id"), "/other/1") is None
    assert one(spark, T.escape_html, '<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
