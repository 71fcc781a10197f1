"""op1, op2, op3 and op5: held-out accuracy, brute force, defined results for odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from lexloom.llm import class_lm, decontaminate, quality_rank, rule_ledger

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(k, m=5):
    return zlib.crc32(str(k).encode()) % m


def test_block_max_wand_finds_all_items_over_the_threshold():
    r = random.Random(1)
    words = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(r.choice(words[: 20 + 2 * (k % 30)]) for _ in range(r.randint(8, 40))) + ".") for k in range(70)]
    index = decontaminate.Index(items)
    for _ in range(200):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 64))) if r.random() < 0.5 else r.choice(items)[1]
        query = index.terms.find(decontaminate.word_hashes(text))
        query = query[query >= 0]
        score = np.zeros(len(items))
        for t in np.unique(query):
            score[index.items[t]] += index.impacts[t]
        assert set(index.search(query)) == set(np.flatnonzero(score >= 1 - 1e-9).tolist())
        # the joint bound never misses one
        if (score >= 1).any():
            assert decontaminate.passages_worth_searching(index, query, np.zeros(len(query), np.int64), np.arange(len(query)) % 32)


def test_op1(spark, docs, none, make_prose):
    prose = make_prose
    item = prose(77, 25) + " What is the answer to this long question here."
    items = spark.createDataFrame([(1, item), (2, prose(78, 30)), (3, None), (4, ""), (5, "?"), (None, item)], "item_id long, text string")
    hosts = [(1000, prose(79, 200) + " " + item.upper() + " " + prose(80, 200)), (1001, prose(81, 300)), (1002, item.replace(" ", "\n")), (1002, item.replace(" ", "\n")), (1003, " ".join(item.split()[:6])), (None, item), (1004, None), (1005, "")]
    got = decontaminate.leaks(spark.createDataFrame(hosts, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1000, 1), (1002, 1), (1002, 1)]
    assert decontaminate.leaks(docs, items.where("false")).count() == 0
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(docs, items).count() == 0


def test_op2_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rank.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc(r.doc_id) == 0) for r in rows) and len(held) > 40
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_op2_odd_rows(spark, docs, none, known):
    labels = spark.createDataFrame([(k, k % 2, 0) for k, _ in known if k < 40] + [(40, 1, 0), (41, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rank.quality_scores(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in known)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_rank.quality_scores(docs, labels.where("false")).select("score").distinct().count() == 1
    assert quality_rank.quality_scores(none, labels).count() == 0


def test_exchange_ends_where_no_single_move_raises_the_likelihood():
    r = np.random.default_rng(2)
    kind = r.integers(0, 3, 40)
    pairs = np.zeros((41, 41))
    for a in range(40):
        for b in range(40):
            pairs[a, b] = r.poisson(12 if (kind[a] + 1) % 3 == kind[b] else 1)
    pairs[40, :40] = pairs[:40, 40] = 3
    f = lambda x: x * np.log(np.maximum(x, 1))

    def likelihood(member):
        hot = np.eye(7)[member]
        table = hot.T @ pairs @ hot
        return f(table).sum() - f(table.sum(1)).sum() - f(table.sum(0)).sum()

    member = class_lm.exchange(pairs, 7, 50)
    best = likelihood(member)
    assert best > likelihood(np.append(np.arange(40) % 6, 6)) and (member == 6).tolist() == [False] * 40 + [True]
    for w in range(40):
        for c in range(6):
            moved = member.copy()
            moved[w] = c
            assert likelihood(moved) <= best + 1e-6


def test_op3(docs, none, known):
    got = class_lm.class_model_scores(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in known)
    count = collections.Counter()
    for k, t in known:
        if crc(k) != 1:
            count.update([*WORD.findall(t.translate(LOWER)), None])
    n, v = sum(count.values()), len(count)
    text = dict(known)
    for r in got:
        tokens = [*WORD.findall(text[r.doc_id].translate(LOWER)), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(count[w] > 0 for w in tokens), n, crc(r.doc_id) == 1)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0
    assert class_lm.class_model_scores(none).count() == 0


def test_op3_rare_words_are_joined(docs, known, monkeypatch):
    whole = {r.doc_id: (r.n_known, r.base_score) for r in class_lm.class_model_scores(docs).collect()}
    monkeypatch.setattr(class_lm, "HEAD", 12)
    monkeypatch.setattr(class_lm, "KINDS", 8)
    for r in class_lm.class_model_scores(docs).collect():
        assert r.n_known == whole[r.doc_id][0] and math.isclose(r.base_score, whole[r.doc_id][1], rel_tol=1e-9)


def test_op3_beats_unigrams_on_held_out_texts(spark, sf_dir):
    rows = class_lm.class_model_scores(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def measure(t):
    w = WORD.findall(t)
    where = collections.defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    covered = {i + d for at in where.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_op5(docs, none, known):
    got = rule_ledger.apply_policy(rule_ledger.ledger(docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((k, *measure(t)) for k, t in known)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert rule_ledger.ledger(none).count() == 0


def test_op5_repeats(spark):
    r = random.Random(6)
    rows = [(k, " ".join(r.choice("abcdefghi"[: 2 + k % 8]) for _ in range(r.randint(0, 60)))) for k in range(200)]
    got = rule_ledger.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.n_repeat_words == measure(rows[x.doc_id][1])[4] for x in got)


def test_op5_policies_and_ablations(docs):
    ledger = rule_ledger.ledger(docs)
    failures = [r.failures for r in ledger.collect()]
    for version, mask in rule_ledger.POLICIES.items():
        assert rule_ledger.apply_policy(ledger, version).where("kept").count() == sum(f & mask == 0 for f in failures)
    for r in rule_ledger.ablations(ledger, 3).collect():
        bit = rule_ledger.BIT[r.rule]
        assert (r.failed, r.failed_alone, r.kept_without) == (sum(f & bit > 0 for f in failures), sum(f == bit for f in failures), sum(f & ~bit == 0 for f in failures))


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.textkit.saved(stage(spark, docs, sf_dir))
        assert docs.columns == columns and 0.8 * before < docs.count() <= before, name
        before = docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == before and last.where("not round_trip").count() == 0
