"""op13: rankings against brute force, in blocks and shards of any size; ties, repeats, odd rows."""

import collections
import math
import random
import re
import types

import numpy as np
import pyarrow as pa

from lexloom.llm import impact_index as I

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    bags = [(d, collections.Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item in sorted({i for i, _ in items if i is not None}):
        text = min((t for i, t in items if i == item and t is not None), default="")
        scored = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * b[w] // (1000 * b[w] + 12 * m)) for w in terms(text) if w in b)
            scored.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = ["Été", "naïve", "x1", "漢字", "😀"] + [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(r.choice(words) if r.random() < 0.7 else "the" for _ in range(r.randint(0, 60)))) for k in range(n)]
    docs += [(900 + k, docs[3][1]) for k in range(30)] + [docs[5], docs[5], (None, "w1 w2"), (700, None), (701, ""), (702, "?! \x7f"), (703, "w1 " * 30000)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for k in range(25)]
    items += [(50, docs[3][1]), (51, "the THE the"), (52, None), (53, "nowhere"), (54, ""), (None, "w1"), (3, "w9"), items[7], items[7], (55, "w1 " * 500)]
    return docs, items


def rows(df):
    return sorted((x.item_id, x.rank, x.doc_id, x.score) for x in df.collect())


def test_rankings(spark, monkeypatch):
    docs, items = corpus(1, 200)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as terms", "2 as n", "3 as item_id", "4 as score").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as rank")
    want = brute(docs, items)
    assert rows(I.ranked(table, asked)) == want
    monkeypatch.setattr(I, "ITEM_BYTES", 400)  # many scans
    assert rows(I.ranked(table, asked)) == want


def test_nothing_to_rank(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert I.ranked(docs.limit(0), items).collect() == []
    assert I.ranked(docs, items.limit(0)).collect() == []
    assert I.ranked(docs.withColumn("text", docs.text.substr(0, 0)), items).collect() == []
    assert [tuple(x) for x in I.ranked(docs, items).collect()] == brute([(1, "a b")], [(1, "a")])


def test_blocks_of_any_size(monkeypatch):
    docs, items = corpus(2, 150)
    docs, items = [d for d in docs if d[0] is not None], [(k, t) for k, t in dict(items[::-1]).items() if k is not None and t]
    queries = I.Queries(items)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
    [found] = list(I.postings_of(types.SimpleNamespace(value=queries))([batch]))
    df = np.bincount(found.column("terms").flatten().to_numpy(), minlength=queries.n_terms)
    n_docs, n_terms = found.num_rows, sum(found.column("n").to_pylist())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df])
    for block, postings, held in ((8192, 500_000, 128), (70, 10**6, 7), (64, 300, 1), (3, 1, 128)):
        monkeypatch.setattr(I, "BLOCK", block)
        monkeypatch.setattr(I, "POSTINGS", postings)
        monkeypatch.setattr(I, "ITEMS", held)
        work = I.search_blocks(types.SimpleNamespace(value=queries), types.SimpleNamespace(value=weights), n_docs, n_terms, 20)
        got = collections.defaultdict(list)
        for b in work([found.slice(0, 60), found.slice(60)]):
            for x in b.to_pylist():
                got[x["item_id"]].append((-x["score"], x["doc_id"]))
        ranks = [(i, r + 1, d, -s) for i in sorted(got) for r, (s, d) in enumerate(sorted(got[i])[:20])]
        assert ranks == brute(docs, items)
