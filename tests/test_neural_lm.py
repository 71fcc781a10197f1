"""The neural model: gradients against differences, sums over partitions, held-out loss, scores against a loop, saving, warm starts, reranking."""

import math
import random

import numpy as np
import pytest

from lexloom.operators import ask
from lexloom.operators import neural_lm as N
from lexloom.operators.index import CorpusIndex


def sentences(seed, n):
    """Texts of a small grammar, so that a context tells much of the next word."""
    r = random.Random(seed)
    subject = {"gear": ["turns", "meshes"], "shaft": ["turns", "bends"], "bearing": ["holds", "wears"]}
    out = []
    for _ in range(n):
        s = r.choice(list(subject))
        out.append(f"the {s} {r.choice(subject[s])} and the {r.choice(['oil', 'heat'])} {r.choice(['rises', 'falls'])}！" * r.randint(1, 3))
    return out


def table(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture(scope="module")
def model(spark):
    return N.trained(table(spark, sentences(1, 300)).repartition(4), steps=60)


def test_gradient_is_that_of_differences():
    r = np.random.default_rng(2)
    m = N.NeuralLM.fresh([f"t{k}" for k in range(6)], context=2, dim=3, hidden=4, seed=3)
    contexts, targets = r.integers(0, 7, (9, 2)), r.integers(0, 7, 9)
    _, grads = N.gradient(m.weights, contexts, targets)
    for w, g in zip(m.weights, grads):
        for _ in range(12):
            at = tuple(r.integers(0, s) for s in w.shape)
            old, losses = w[at], []
            for d in (1e-5, -1e-5):
                w[at] = old + d
                losses.append(N.gradient(m.weights, contexts, targets)[0])
            w[at] = old
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_partitions_sum_to_the_whole(spark):
    m = N.NeuralLM.fresh([f"t{k}" for k in range(20)], seed=1)
    r = random.Random(5)
    rows = [[r.randint(0, 20) for _ in range(r.choice([1, 2, 30, 5000]))] for _ in range(25)]
    contexts, targets = np.concatenate([N.windows(np.array(x), 3) for x in rows]), np.concatenate([np.array(x) for x in rows])
    loss, grads = N.gradient(m.weights, contexts, targets)
    for parts in (1, 6):
        n, got, flat = N.total_gradient(spark.createDataFrame([(x,) for x in rows], "ids array<int>").repartition(parts), m.weights)
        assert n == len(targets) and got == pytest.approx(loss) and np.allclose(flat, np.concatenate([g.ravel() for g in grads]))
    assert N.total_gradient(spark.createDataFrame([], "ids array<int>"), m.weights)[0] == 0


def test_held_out_loss_falls(spark, model):
    held = table(spark, sentences(2, 60))

    def loss(m):
        [r] = N.sequence_scores(m, held, "doc_id").selectExpr("-sum(log_prob) / sum(n) as x").collect()
        return r.x

    fresh = N.NeuralLM.fresh(model.tokens)
    assert loss(fresh) == pytest.approx(math.log(len(model.tokens) + 1), abs=0.2)
    assert loss(model) < 0.9 < 0.4 * loss(fresh) and model.losses[-1] < model.losses[0] and model.steps == 60
    n = sum(len(t.replace("！", " ！ ").split()) for t in sentences(2, 60))
    assert N.sequence_scores(model, held, "doc_id").selectExpr("sum(n)").first()[0] == n


def test_scores_are_those_of_a_loop(spark, model):
    texts = ["the gear turns and the oil rises！", "oil the the bends unknownword", "", None, "！" * 5000]
    got = {r.doc_id: (r.n, r.log_prob) for r in N.sequence_scores(model, table(spark, texts).selectExpr("*", "1 as n", "2 as log_prob"), "doc_id").collect()}
    for k, t in enumerate(texts):
        tokens = (t or "").replace("！", " ！ ").split()
        ids, e = [0, 0, 0, *model.encode(tokens).tolist()], model.weights
        total = 0.0
        for at in range(3, len(ids)):
            h = np.tanh(np.concatenate([e[0][i] for i in ids[at - 3 : at]]) @ e[1] + e[2])
            z = h @ e[3] + e[4]
            total += z[ids[at]] - math.log(np.exp(z).sum())
        assert got[k] == (len(tokens), pytest.approx(total))
    assert got[0][1] / got[0][0] > got[1][1] / got[1][0]


def test_saved_warm_started_and_pretrained(spark, model, tmp_path):
    path = f"file://{tmp_path}/model"
    model.save(spark, path)
    again = N.NeuralLM.load(spark, path)
    assert again.tokens == model.tokens and again.steps == 60 and all((a == b).all() for a, b in zip(again.weights, model.weights))
    more = table(spark, [*sentences(3, 200), "pump pump pump pump"])
    cold, warm = N.trained(more, steps=1), N.trained(more, steps=1, old=model)
    assert warm.losses[0] < 0.6 * cold.losses[0] and warm.steps == 61 and "pump" in warm.tokens
    assert N.pretrained(spark, path, more).steps == 60  # there is one
    assert N.pretrained(spark, path, more, force=True, steps=2).steps == 62
    assert N.NeuralLM.load(spark, path).steps == 62
    assert N.pretrained(spark, f"{path}2", more, steps=1).steps == 1


def test_too_little_to_train_on(spark):
    assert N.trained(table(spark, [None, "", "one two three"])) is None
    assert N.trained(table(spark, [])) is None
    assert N.trained(table(spark, ["a b c d", None, "e f g h"]), steps=1).losses[0] > 0


def test_confidence_orders_sentences(spark, model):
    """Of two sentences with the same shared terms the later one is likelier, and comes first with the model alone."""
    docs = table(spark, ["rises oil falls gear heat the and the bends. the gear turns and the oil rises. " + "x" * 120])
    asked = spark.createDataFrame([(1, "gear")], "qid long, query string")
    nothing = lambda s: s.isNull()
    index = CorpusIndex.build(docs)
    plain, ranked = (ask.answers(index, docs, asked, junk=nothing, model=m).first().text for m in (None, model))
    assert plain.startswith("rises oil") and ranked.startswith("the gear turns")
