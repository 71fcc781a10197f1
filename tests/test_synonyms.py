"""Learnt synonyms and senses against brute force over all pairs of terms."""

import collections
import itertools
import math
import random

import pytest

from lexloom.operators import retrieve as R
from lexloom.operators import synonyms as S
from lexloom.operators.index import CorpusIndex


def corpus():
    """Words of three topics; `bank` is in two of them, and `shore` and `money` are each like one half of it."""
    r = random.Random(3)
    topics = {"river": "water flows boat fish swim".split(), "cash": "loan credit pay coin vault".split(), "gear": "turns oil mesh teeth wheel".split()}
    heads = {"river": ["bank", "shore", "coast"], "cash": ["bank", "money", "funds"], "gear": ["cog", "pinion"]}
    out = []
    for _ in range(400):
        t = r.choice(list(topics))
        out.append(" ".join(f"{r.choice(topics[t])} {r.choice(heads[t])} {r.choice(topics[t])} stop{r.randint(0, 99999)} stop{r.randint(0, 99999)}" for _ in range(r.randint(0, 4))))
    return [*out, None, "", "one", "same same same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(corpus())], "doc_id long, text string").selectExpr("*", "1 as term", "2 as n").repartition(4)


def brute_weights(window, least):
    n = collections.Counter()
    for t in corpus():
        words = (t or "").split()
        for i, j in itertools.combinations(range(len(words)), 2):
            if j - i <= window and words[i] != words[j]:
                n[tuple(sorted((words[i], words[j])))] += 1
    n = {(a, b): c for p, c in n.items() if c >= least for a, b in (p, p[::-1])}
    margin = collections.Counter()
    for (a, _), c in n.items():
        margin[a] += c
    total = sum(margin.values())
    w = {k: round(math.log(c * total / (margin[k[0]] * margin[k[1]])), 9) for k, c in n.items()}
    return {k: x for k, x in w.items() if x > 0}


def brute_links(weights, features, least):
    rows = collections.defaultdict(list)
    for (a, c), w in weights.items():
        rows[a].append((-w, c))
    vectors = {}
    for a, x in rows.items():
        kept = sorted(x)[:features]
        length = math.sqrt(sum(w * w for w, _ in kept))
        vectors[a] = {c: -w / length for w, c in kept}
    out = {}
    for a, b in itertools.permutations(vectors, 2):
        cos = round(sum(x * vectors[b].get(c, 0.0) for c, x in vectors[a].items()), 9)
        if cos >= least:
            out[a, b] = cos
    return out


@pytest.mark.parametrize("window,least,features,cosine", [(2, 5, 50, 0.7), (1, 2, 4, 0.3), (3, 1, 50, 0.95)])
def test_links_are_those_of_all_pairs(docs, window, least, features, cosine):
    weights = brute_weights(window, least)
    assert {(r.term, r.context): r.w for r in S.ppmi(S.cooccurrences(docs, window, least)).collect()} == pytest.approx(weights)
    got = {(r.term, r.other): r.cos for r in S.learnt(docs, window, least, features, cosine).collect()}
    assert got == pytest.approx(brute_links(weights, features, cosine), abs=2e-9)
    assert cosine > 0.5 or got


def test_senses_part_and_fit(spark, docs):
    weights = S.ppmi(S.cooccurrences(docs, 2, 3)).cache()
    links = S.similar(S.unit_vectors(weights), 0.5).cache()
    near = collections.defaultdict(dict)
    for r in links.collect():
        near[r.term][r.other] = r.cos
    got = collections.defaultdict(list)
    groups = S.senses(links, 20).cache()
    for r in groups.orderBy("term", "sense").collect():
        got[r.term].append(list(r.members))
        assert r.weight == pytest.approx(max(near[r.term][m] for m in r.members))
    for term, parts in got.items():
        top = sorted(near[term], key=lambda x: (-near[term][x], x))[:20]
        assert sorted(itertools.chain(*parts)) == sorted(top)
        for p, q in itertools.combinations(parts, 2):
            assert not any(b in near[a] for a in p for b in q)
    of_bank = {m: k for k, p in enumerate(got["bank"]) for m in p}
    assert of_bank["shore"] == of_bank["coast"] != of_bank["money"] == of_bank["funds"]
    asked = spark.createDataFrame([(1, "bank water"), (2, "bank loan"), (3, "bank")], "qid long, query string")
    fitting = S.fitting_synonyms(R.query_terms(asked), groups, weights)
    chosen = collections.defaultdict(set)
    for r in fitting.where("term = 'bank'").collect():
        chosen[r.qid].add(r.synonym)
    assert "shore" in chosen[1] and "money" not in chosen[1] and "money" in chosen[2] and "shore" not in chosen[2] and len(chosen[3]) > 0
    texts = spark.createDataFrame([(1, "the shore"), (2, "the money")], "doc_id long, text string")
    index = CorpusIndex.build(texts)
    found = {(r.qid, r.doc_id) for r in R.bm25_scores(index, asked, synonyms=fitting).where("score > 0 and qid < 3").collect()}
    assert found == {(1, 1), (2, 2)}


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, None), (2, "alone"), (3, "")], "doc_id long, text string")
    assert S.learnt(none).collect() == [] and S.senses(S.learnt(none)).collect() == []


@pytest.mark.parametrize("block", [3, 2048])
def test_best_links_and_senses_come_from_vectors(spark, docs, monkeypatch, block):
    """Blocks, the k best of a task, asked terms alone and senses made beside vectors give what all links give."""
    monkeypatch.setattr(S, "BLOCK", block)
    vectors = S.unit_vectors(S.ppmi(S.cooccurrences(docs, 2, 3))).cache()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    links = S.similar(vectors, 0.3).cache()
    assert {(r.term, r.other): r.cos for r in links.collect()} == pytest.approx(brute_links(brute_weights(2, 3), 50, 0.3), abs=2e-9)
    assert links.count() == links.select("term", "other").distinct().count()
    held, asked = S.packed(vectors), spark.createDataFrame([("bank",), ("water",), ("unknown",)], "term string")
    for k in (1, 2, 20):
        assert rows(S.nearest(held, k, 0.3)) == rows(S.synonyms(links, k))
        assert rows(S.nearest(held, k, 0.3, asked)) == rows(S.synonyms(links, k).join(asked, "term", "left_semi"))
    assert rows(S.senses_of(held, 3, 0.3)) == rows(S.senses(links, 3))
    assert rows(S.senses_of(held, 3, 0.3, asked)) == rows(S.senses(links, 3).join(asked, "term", "left_semi"))


def test_pairs_are_counted_in_parts(spark, docs, monkeypatch):
    """Counts that leave a task in several parts, and crowded buckets, change nothing."""
    want = sorted(map(tuple, S.cooccurrences(docs, 3, 1).where("n >= 4").collect()))
    monkeypatch.setattr(S, "HELD", 50)
    monkeypatch.setattr(S, "KEYS", 2)
    monkeypatch.setattr(S, "SMALLEST", 11)
    monkeypatch.setattr(S, "LARGEST", 11)
    assert sorted(map(tuple, S.cooccurrences(docs, 3, 4).collect())) == want and want


def test_rare_pairs_and_all_links_are_not_shuffled(spark, sf_dir):
    """Neither pairs of words as words of all texts nor links are dealt out and joined again."""
    plan = S.learnt(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0] and "Join" not in plan.split("MapInArrow")[0]
