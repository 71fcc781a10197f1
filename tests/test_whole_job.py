"""Registered queries do their whole job: on fixtures with rows and characters that a filter or a prefix would lose, they equal their SQL, and rules that only Japanese text sets off fire."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import normal

import __spark_entry__ as entry
from lexloom.functions import text as T
from lexloom.operators import feedback
from lexloom.plans.phrases import PHRASES

WIDE = "\u3000"  # the ideographic blank


def md5(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with late words, astral characters, null and empty texts, brackets, repeats and keys of all kinds."""
    path = tmp_path_factory.mktemp("fixture")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")

    late = "x" * 300 + " write the doc and test it"
    texts = ["a" * 64 + "b", "a" * 64 + "c", "歯車😀" * 300, "short", "", None, "gear number6 turns. shaft only6 stands. " * 3, "(x) gear, bearing: " + PHRASES[0] * 3, "歯車.軸" + WIDE + "終わり", late]
    write("documents", [(k, t, f"s{k // 2}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    write("labels", [(k, k % 2) for k in range(10) if k != 5], "doc_id long, quality int")
    write("benchmark", [(0, "gear number6 and the shaft"), (1, "歯車とは何ですか"), (2, "zzz"), (3, late)], "item_id long, text string")
    write("conversations", [(1, 0, late), (1, 1, "short doc"), (2, 0, None), (2, 1, WIDE + " "), (3, 0, "修正して" + WIDE + "ください bug")], "conv_id long, turn long, text string")
    titles = ["4・1 歯車（gear） の強さ", "Gears (spur) of steel", WIDE + "plain" + WIDE + "title"]
    write("pages", [(k, f"http://h/{k}?a=1&b=x%20y", f"<html><script>f(1)</script><title>{t}</title></html>") for k, t in enumerate(titles)], "page_id long, url string, html string")
    return str(path)


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in "documents labels benchmark conversations pages".split():
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return c


LARGE = "chunk_fixed chunk_packed tf df_idf tfidf query_vec cosine_topk bm25_topk bm25_zero_fill pruned_postings impact_search mmr_k2 mmr_full pair_cosine context_build groundedness hallucination_rate faithful_runs hash_embed answer_recall".split()
TEXT = "emb_tokens emb_token_ids lm_tokens fnv_hash space_tokens detokenized sentence_split clean_sentence_split feedback_sentence_split key_terms question_sig garbage_strip inline_clean punct_restore punct_restore_before_gap fill_clean tidy clean_line sanitize junk_flag heading_math_flag formula_signal_and_key web_request url_params route_match char_ratio html_escape title_normalize derubble front_matter emit_fold deinterleave".split()
STATE = "term_weights top_weights event_log accepted_pool rejected_pool blocked_sets blocked_anti_join feedback_stats intent_detect plan_trace trace_summary reflect suggestions readability_hist long_tail_hist ask_answers greedy_text".split()


@pytest.mark.parametrize("name", [*LARGE, *TEXT, *STATE])
def test_query_equals_sql_on_odd_rows(spark, folder, duck, name):
    assert normal(entry.queries()[name](spark, folder).toPandas()) == normal(duck.sql(entry.oracle_sql()[name]).df())


def run(spark, name, sf):
    return entry.queries()[name](spark, sf).collect()


def test_rules_fire(spark, sf_dir):
    """No query of rules is empty of what its rules act on."""
    junk = run(spark, "junk_flag", sf_dir)
    assert 0 < sum(r.junk for r in junk) < sum(r.n for r in junk)
    assert {r.reason for r in run(spark, "readability_hist", sf_dir)} >= {"short", "deictic", "low_jp", "parens", "math", "nonfinal", "ok"}
    assert {r.reason for r in run(spark, "long_tail_hist", sf_dir)} >= {"short", "deictic", "low_jp", "parens", "nonfinal", "ok"}
    assert {r.changed for r in run(spark, "punct_restore", sf_dir)} == {True, False}
    assert {r.filled for r in run(spark, "unique_key_fill", sf_dir)} == {True, False}
    assert {r.deinterleaved for r in run(spark, "deinterleave", sf_dir)} == {True, False} and any(r.n for r in run(spark, "emit_fold", sf_dir))
    assert {r.wants for r in run(spark, "web_request", sf_dir)} == {True, False}
    assert {r.cat for r in run(spark, "calc_lookup", sf_dir)} == {"formula", "table", "none"}
    assert {(r.id, r.why) for r in run(spark, "calc_compute", sf_dir)} >= {("unknown", "unknown formula"), ("fourier", "division by zero"), ("tensile", None)} and len({r.id for r in run(spark, "calc_compute", sf_dir)}) == 14
    assert any(r.title != r.norm for r in run(spark, "title_normalize", sf_dir))


def test_ideographic_blanks_are_blanks(spark):
    one = lambda f, text: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(T.sentences, f"{WIDE}歯車は動く。{WIDE}軸も動く。{WIDE}") == ["歯車は動く。", "軸も動く。"]
    assert one(T.clean_line, f"{WIDE}## 見出し{WIDE}") == "## 見出し" and one(T.clean_line, f"> 本文{WIDE}\u00a0") == "本文"
    assert one(T.normalize_title, f"4・1{WIDE}歯車{WIDE}の 強さ") == "歯車の強さ"
    assert one(T.clean_sentences, f"一二三{WIDE}四五{WIDE}六七。一二三四五六七八。") == ["一二三 四五 六七。", "一二三四五六七八。"]
    assert one(T.space_tokens, f"a{WIDE}b") == ["a", WIDE, "b"] and one(T.embedding_tokens, f"a{WIDE}b") == ["a", "b"]


def test_term_weights_compose_over_spans(spark):
    """Spans of any size give the fold of all events in order."""
    labels = ["good", "good", "bad", "bad", "bad", "good", "good", "good", "good", "good", "good", "bad", "good", "bad", "bad"]
    events = spark.createDataFrame([(k, "gear shaft" if k % 3 else "gear", x) for k, x in enumerate(labels)], "ts long, q string, label string")

    def fold(steps):
        w = 1.0
        for x in steps:
            w = max(1.0, min(3.0, w + (0.5 if x == "good" else -0.5)))
        return w

    want = {"gear": fold(labels), "shaft": fold(x for k, x in enumerate(labels) if k % 3)}
    for span in (1, 2, 4, 7, 50):
        assert {r.term: r.w for r in feedback.term_weights(events, span=span).collect()} == want


def fnv1a(text):
    h = 2166136261
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[i : i + 2], "big")) * 16777619 & 0xFFFFFFFF
    return h


def test_fnv_hash_covers_whole_texts(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text}
    assert {r.doc_id: r.hash for r in run(spark, "fnv_hash", folder)} == {k: fnv1a(t) for k, t in texts.items()}


def test_goals_are_whole_turns(spark, folder):
    got = {r.goal_id: r.intents for r in run(spark, "intent_detect", folder)}
    assert got[1000] == "test doc" and got[2000] == got[2001] == "" and got[3000].startswith("fix")


def test_groundedness_of_all_documents(spark, folder):
    rows = run(spark, "groundedness", folder)
    assert {r.id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text}


def test_text_rank_equals_a_plain_computation(spark, sf_dir):
    """PageRank over term cosines, twenty rounds, the two best sentences in text order."""
    import math
    import re
    from collections import Counter

    def sentences(text):
        flat = re.sub(r"\s+", " ", text).strip()
        return [x.strip() for x in re.split(r"(?<=[。．！？!?])|(?<=\.)(?=\s|$)", flat) if x.strip()]

    for r in run(spark, "text_rank_summary", sf_dir):
        text = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.col("item_id") == r.doc_id).first().text if r.doc_id < 6 else None
        if text is None:
            continue
        ss = sentences(text)
        bags = [Counter(re.findall(r"[a-z][a-z0-9\-]+", x.lower())) for x in ss]
        norm = [math.sqrt(sum(v * v for v in b.values())) for b in bags]
        cos = [[sum(a[t] * b[t] for t in a) / (norm[i] * norm[j]) if i != j and norm[i] and norm[j] else 0.0 for j, b in enumerate(bags)] for i, a in enumerate(bags)]
        rank = [1.0] * len(ss)
        for _ in range(20):
            rank = [0.15 + 0.85 * sum(cos[i][j] / sum(cos[i]) * rank[i] for i in range(len(ss)) if cos[i][j]) for j in range(len(ss))]
        best = sorted(sorted(range(len(ss)), key=lambda k: (-round(rank[k], 9), k))[:2])
        assert r.summary == " ".join(ss[k] for k in best)
