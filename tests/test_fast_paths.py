"""Work done inside tasks, against the plain columns: hashes, contexts of seeds, nearest vectors, the order of lines."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions import vectors as V
from lexloom.operators import corpus, embed, lm

WORDS = ["gear", "Shaft", "OIL", "漢", "字", "。", "\n", "don't", "7", "😀", "İ", "ΣΑΣ", "a" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(6)
    rows = [(k, " ".join(r.choices(WORDS, k=r.randint(0, 40)))) for k in range(200)]
    return spark.createDataFrame([*rows, (300, None), (301, ""), (302, " \t"), (5, "gear gear")], "doc_id long, text string").repartition(4)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hashes_of_many_texts(spark, docs):
    texts = [*WORDS, "", "\u0000x", "\U0010ffff"]
    plain = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fnv1a(F.col("t")).alias("h")).collect()}
    assert embed.fnv1a(texts).tolist() == [plain[t] for t in texts] and embed.fnv1a([]).tolist() == []
    each = docs.select("doc_id", F.explode(F.array_distinct(T.token_ids(T.embedding_tokens(F.col("text"))))).alias("t"))
    assert rows(embed.token_id_sums(docs)) == rows(each.groupBy("doc_id").agg(F.count("*"), F.sum(F.col("t.id").cast("long")), F.max("t.id")))


def test_contexts_of_seeds_alone(spark, docs):
    seeds = spark.createDataFrame([(1, ["gear", "OIL"]), (2, ["OIL"]), (3, []), (4, ["none", "gear"]), (5, ["漢", "。"]), (6, ["none", "nor"]), (7, None), (8, ["x", "\n", "7"])], "sid long, tokens array<string>")
    whole = lm.ngram_counts(docs)
    asked = lm.contexts(seeds).select("ord", "ctx").distinct()
    assert rows(lm.ngram_counts(docs, seeds=seeds)) == rows(whole.join(asked, ["ord", "ctx"], "left_semi").select("ord", "ctx", "tok", "n"))
    assert rows(lm.backoff(lm.ngram_counts(docs, seeds=seeds), seeds)) == rows(lm.backoff(whole, seeds))
    grown, _ = lm.extended(lambda s: lm.ngram_counts(docs, seeds=s), seeds, max_tokens=3)
    assert rows(grown) == rows(lm.extended(whole, seeds, max_tokens=3)[0])


def test_a_seed_with_a_long_context_never_meets_all_tokens(spark, docs):
    seeds = spark.createDataFrame([(1, ["gear", "OIL"])], "sid long, tokens array<string>")
    plan = lm.backoff(lm.ngram_counts(docs), seeds)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "regexp_extract_all" not in plan


@pytest.mark.parametrize("k", [1, 5, 40])
def test_nearest_equal_all_cosines(spark, k):
    r = random.Random(8)
    vectors = [(n, [float(r.randint(-2, 2)) for _ in range(4)]) for n in range(300)] + [(400, [0.0] * 4)]
    items = spark.createDataFrame(vectors, "item_id long, v array<double>").repartition(3)
    queries = items.where("item_id % 7 = 0 or item_id = 400").withColumnRenamed("item_id", "qid")
    every = rows(embed.nearest(queries, items, 0).where(F.col("rank") <= k))
    assert rows(embed.nearest(queries, items, k)) == every
    assert rows(embed.nearest(queries, items, k, 0.9)) == [x for x in every if x[2] >= 0.9]
    odd = items.union(spark.createDataFrame([(500, None), (501, [1.0])], "item_id long, v array<double>"))
    assert rows(embed.nearest(queries, odd, k).where("item_id < 500 and cos is not null"))
    plan = embed.nearest(queries, items, k)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and V.cosine is not None


def test_sentences_are_made_once(docs):
    lines = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("body"))
    plan = corpus.rewrites(corpus.choose_order(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "aggregate(" in x]
