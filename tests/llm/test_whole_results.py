"""Whole queries against brute force: op1's leaks, op3's scores, op8's order of ties, op9's long texts, the pipeline's odd rows."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import class_lm, decontaminate, site_lines, textkit


def brute_leaks(docs, items):
    """(doc_id, item_id, n_passages) by scoring every passage against every item."""
    words = lambda t: t.lower().split()
    bags = [collections.Counter(words(t)) for _, t in items]
    lengths = [sum(b.values()) for b in bags]
    mean = sum(lengths) / len(lengths)
    df = collections.Counter(w for b in bags for w in b)
    idf = {w: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    impact = [{w: idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * lengths[k] / mean)) for w, n in b.items()} for k, b in enumerate(bags)]
    need = [0.5 * sum(x.values()) * min(1.0, 48 / lengths[k]) for k, x in enumerate(impact)]
    seq = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for doc, text in docs:
        w = words(text)
        for k, (item, t) in enumerate(items):
            parts = [words(p) for p in decontaminate.question_and_answer(t)]
            if min(map(len, parts)) < 3:
                parts = [words(t)] * 2
            n = min(3, len(parts[0]))
            near, hits = set(), 0
            for h in range(-1, max(1, -(-len(w) // 32))):  # a passage begins half a passage before the text and ends after it
                a, b = max(0, h) * 32, min((h + 2) * 32, len(w))
                if sum(impact[k].get(x, 0.0) for x in set(w[a:b])) >= need[k] - 1e-9:
                    near |= seq(w[max(0, a - 32) : b + 32], n)
                    hits += 1
            if hits and all(sum(g in near for g in seq(p, n)) >= 0.5 * len(seq(p, n)) for p in parts):
                out.append((doc, item))
    return sorted(out)


def test_op1_finds_what_brute_force_finds(spark):
    r = random.Random(9)
    words = [f"{a}{b}" for a in "klmnprst" for b in ("ana", "eru", "ilo", "osa", "uva", "yde")]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 12, 30, 60, 150])))) for k in range(40)]
    items = [(k, t if k % 3 else t + ". " + " ".join(r.choice(words) for _ in range(6)) + "?") for k, t in items]
    items += [(100, "zzzunique"), (101, "Zzpair wwpair"), (102, "only here")]
    docs = []
    for k in range(60):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 150)))]
        for _ in range(r.randint(0, 2)):
            t = r.choice(items)[1].split()
            cut = r.randint(0, len(t) // 3)
            parts += [" ".join(t[cut:]).upper(), " ".join(r.choice(words) for _ in range(r.randint(0, 80)))]
        docs.append((k, " \n".join(parts)))
    docs += [(200, "x " * 100 + "ZZZUNIQUE"), (201, "zzpair wwpair"), (202, "wwpair zzpair"), (203, "")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found, want = sorted((x.doc_id, x.item_id) for x in got), brute_leaks(docs, items)
    assert found == want
    assert {(200, 100), (201, 101)} <= set(found) and (202, 101) not in found


@pytest.mark.parametrize("fold", [1, 0])
def test_op3_scores_follow_the_formula(docs, known, fold):
    train = [(k, t) for k, t in known if class_lm.is_training([k], fold)[0]]
    count, last = collections.Counter(), {}

    def words(text):
        h, e, _ = class_lm.tokens(*textkit.text_buffer(pa.array([text])))
        return list(zip(h.view(np.int64).tolist(), e.tolist()))

    for _, t in train:
        count.update(h for h, _ in words(t))
    top = sorted(count, key=lambda h: (-count[h], h))
    assert len(top) <= class_lm.KINDS
    kind = {h: k for k, h in enumerate(top)}
    types = lambda t: [kind.get(h, class_lm.KINDS + e) for h, e in words(t)] + [class_lm.END]
    pairs = np.zeros((class_lm.TYPES, class_lm.TYPES))
    for _, t in train:
        x = types(t)
        for a, b in zip([class_lm.END, *x], x):
            pairs[a, b] += 1
    member = class_lm.exchange(pairs)
    n, v, c2 = collections.Counter(), collections.Counter(), collections.Counter()
    for h, k in kind.items():
        n[member[k]] += count[h]
        v[member[k]] += 1
    n[class_lm.CLASSES - 1] = len(train)
    v[class_lm.CLASSES - 1] = 1
    for _, t in train:
        x = [class_lm.CLASSES - 1, *member[types(t)]]
        c2.update(zip(x, x[1:]))
    after = collections.Counter()
    for (a, _), m in c2.items():
        after[a] += m
    for r in class_lm.class_model_scores(docs, fold).collect():
        texts = [t for k, t in known if k == r.doc_id]
        score, before = 0.0, class_lm.CLASSES - 1
        for (h, _), k in zip([*words(texts[0]), (None, 0)], types(texts[0])):
            c = member[k]
            own = len(train) if h is None else count[h]
            score += math.log10((c2[before, c] + 0.5) / (after[before] + 0.5 * class_lm.CLASSES)) + math.log10((own + 0.5) / (n[c] + 0.5 * (v[c] + 1)))
            before = c
        assert math.isclose(r.score, score, rel_tol=1e-9) and r.held_out == (not class_lm.is_training([r.doc_id], fold)[0])


def test_op8_orders_equal_losses_alike_at_every_length():
    nbest = pytest.importorskip("lexloom.llm.nbest")
    public = pytest.importorskip("public_tokenizers")
    lattice = nbest.Lattice(public.path("piece_bpe_32k.model"), 4)
    lattice.loss = np.array([[1.0, 2.0, 3.0], [0.5, np.inf, np.inf], [np.inf] * 3, [0.25, 0.5, 4.0]])
    r = np.random.default_rng(3)
    for n in (1, 3, 4, 5, 63, 64, 65, 500):
        for _ in range(5):
            parts = r.integers(0, 4, n)
            ways = [(0.0, ())]
            for x in range(n):  # all parts, none left out
                ways = sorted((w + d, m + ((x, k),) if k else m) for w, m in ways for k, d in enumerate([0.0, *lattice.loss[parts[x]].tolist()]) if d < np.inf)[:40]
            got = lattice.sums(parts)
            assert [w for w, _ in got] == [w for w, _ in ways[: len(got)]] and len(got) == min(4, len(ways))
            assert got == lattice.sums(parts)
            single = [x for x in range(n) if lattice.loss[parts[x], 0] < np.inf]
            if single:  # the second path departs at the earliest of the parts that lose least
                least = min(lattice.loss[parts[x], 0] for x in single)
                assert got[1] == (least, ((min(x for x in single if lattice.loss[parts[x], 0] == least), 1),))


def test_op9_long_texts_and_clashing_names(spark):
    r = random.Random(8)
    shared = [f"a line that many sites share, number {k}" for k in range(300)]
    rows = [(k, "\n".join(r.choice(shared) if r.random() < 0.5 else f"own line {k} {j} of this text" for j in range(3000 if k == 3 else 60)), f"s{k}", "x", "y", 1, 2) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Line_Numbers string, __line_text string, line_doc int, n_lines int")
    got = site_lines.without_shared_lines(df, 5, 16)
    assert got.columns == ["doc_id", "text", "source", "Line_Numbers", "__line_text", "line_doc", "n_lines", "n_removed"]
    sites, first = collections.defaultdict(set), {}
    for k, t, s, *_ in rows:
        for n, line in enumerate(t.split("\n")):
            sites[line].add(s)
            first.setdefault(line, (k, n))
    want = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if len(sites[x]) < 5 or first[x] == (k, n)) for k, t, *_ in rows}
    out = {x.doc_id: x for x in got.collect()}
    assert {k: x.text for k, x in out.items()} == want
    assert all(x["Line_Numbers"] == "x" and x["__line_text"] == "y" and x.n_lines == rows[k][1].count("\n") + 1 for k, x in out.items())


def test_pipeline_odd_rows(spark, tmp_path, make_prose):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = make_prose(50, 120)
    rows = [(1, clean, "en", "a", 1), (2, clean, "en", "b", 1), (2, clean, "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "word " * 30000, "en", None, 1), (None, clean, "en", "a", 1), (6, make_prose(51, 90), "en", "c", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.textkit.saved(stage(spark, docs, str(tmp_path)))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept.append(sorted(r.doc_id for r in docs.collect()))
    # rows without an id leave first; without labels nothing is rejected; of equal texts the least id stays; empty texts link with nothing
    assert kept == [[1, 2, 2, 3, 4, 5, 6], [1, 2, 2, 3, 4, 5, 6], [1, 3, 4, 5, 6], [1, 3, 4, 5, 6]]
    last = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    assert sorted(last) == kept[-1] and last[3].n_pieces == last[4].n_pieces == 0
    none = spark.createDataFrame([], schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
