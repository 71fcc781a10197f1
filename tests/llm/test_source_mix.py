"""op11: targets, the flow's cost and the documents taken, against plain computations; odd rows; the same mix again."""

import collections
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from lexloom.llm import source_mix as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights):
    """Water filling in exact arithmetic."""
    capped = set()
    while True:
        left = sum(sizes) - sum(3 * sizes[k] for k in capped)
        share = {k: Fraction(left * weights[k], sum(weights[j] for j in range(len(sizes)) if j not in capped)) for k in range(len(sizes)) if k not in capped}
        over = {k for k, x in share.items() if x > 3 * sizes[k]}
        if not over:
            return [float(3 * sizes[k] if k in capped else share[k]) for k in range(len(sizes))]
        capped |= over


def least_cost(quota, patterns, room):
    """Cost of the cheapest flow, a word at a time by shortest paths (Bellman-Ford) over patterns [distinct words] and arcs room[p][s]."""
    flow = [[0] * len(quota) for _ in patterns]
    cost = 0
    for s in range(len(quota)):
        for _ in range(quota[s]):
            best = {("s", s): (0, None)}  # from the source that needs a word back to the pool
            for _ in range(2 * (len(quota) + len(patterns)) + 2):
                for p, words in enumerate(patterns):
                    used = sum(flow[p])
                    for t in range(len(quota)):
                        if ("s", t) in best and flow[p][t] < room[p][t] and (("p", p) not in best or best["s", t][0] < best["p", p][0]):
                            best["p", p] = (best["s", t][0], ("s", t))
                        if ("p", p) in best and flow[p][t] > 0 and (("s", t) not in best or best["p", p][0] < best["s", t][0]):
                            best["s", t] = (best["p", p][0], ("p", p))
            ends = [(best["p", p][0] + sum(flow[p]) // words + 1, p) for p, words in enumerate(patterns) if ("p", p) in best and words]
            c, p = min(ends)
            cost += c
            at = ("p", p)
            while at != ("s", s):
                before = best[at][1]
                pattern, source, step = (at[1], before[1], 1) if at[0] == "p" else (before[1], at[1], -1)
                flow[pattern][source] += step
                at = before
    return cost


def test_flow_has_least_cost():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 4)
        own = [r.randint(0, 6) for _ in range(n)]
        shared = [[r.choice([0, 0, 1, 2, 4]) for _ in range(n)] for _ in range(r.randint(0, 4))]
        distinct = [max(x) for x in shared]
        own_room, room = [3 * x for x in own], [[3 * x for x in row] for row in shared]
        held = [own_room[s] + sum(row[s] for row in room) for s in range(n)]
        quota = [r.randint(0, h) for h in held]
        a, f = M.routed(np.array(quota), np.array(own), np.array(own_room), np.array(distinct, np.int64), np.array(room, np.int64).reshape(len(room), n))
        assert (a + f.sum(axis=0)).tolist() == quota and (f <= np.array(room).reshape(len(room), n)).all() and (a <= own_room).all() and (f >= 0).all()
        readings = lambda flow, words: sum(k // words + 1 for k in range(flow)) if words else 0
        cost = sum(readings(int(x), w) for x, w in zip(a, own)) + sum(readings(int(x), w) for x, w in zip(f.sum(axis=1), distinct))
        patterns = own + distinct
        arcs = [[own_room[s] if s == k else 0 for s in range(n)] for k in range(n)] + room
        assert cost == least_cost(quota, patterns, arcs)


def test_targets():
    r = random.Random(6)
    for _ in range(200):
        sizes = [r.choice([0, 1, r.randint(0, 50), r.randint(0, 5000)]) for _ in range(r.randint(1, 25))]
        weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
        assert M.targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights))
    assert M.targets([], []) == []
    with pytest.raises(ValueError):
        M.routed(np.array([4]), np.array([1]), np.array([3]), np.zeros(0, np.int64), np.zeros((0, 1), np.int64))


def corpus():
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(["a", "bé", "漢字", "x"]) for _ in range(n))
    out = [(k, text(r.randint(0, 40)), r.choice(["big"] * 6 + ["é", "Z", "", "b", None])) for k in range(400)]
    out += [(1000 + k, out[k % 7][1], r.choice(["big", "b", "Z", None, "only copies"])) for k in range(120)]
    out += [(2000, None, "big"), (2001, "", "b"), (2002, "w " * 5000, "huge"), (2003, " \t\x0b", "blank"), (None, "a b c", "b"), out[3], out[3]]
    return out


@pytest.mark.parametrize("cells", [500_000, 20])
def test_mix(spark, monkeypatch, cells):
    monkeypatch.setattr(M, "CELLS", cells)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as arc", "2 as number", "3 as hash", "4 as size", "5 as target").repartition(6)
    got = M.mixed(docs).collect()
    known = [(d, len(WORD.findall(t or "")), s) for d, t, s in rows if d is not None]
    assert sorted((x.doc_id, x.size) for x in got) == sorted((d, n) for d, n, _ in known)
    names = sorted({s for _, _, s in known}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, s in known if s == name) for name in names]
    want = plain_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    taken, partial = collections.Counter(), collections.Counter()
    for x in got:
        k = names.index(x.source)
        assert x.source_size == sizes[k] and x.target == pytest.approx(want[k]) and 0 <= x.taken <= 3 * x.size
        taken[x.source] += x.taken
        partial[x.source] += x.size > 0 and x.taken % x.size > 0
    for name, w in zip(names, want):
        assert abs(taken[name] - w) <= 0.5 + 1e-6
    assert sum(partial.values()) < 60  # one row of a pattern and source
    again = M.mixed(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    other = M.mixed(docs, seed=1).collect()
    assert sorted(map(str, other)) != sorted(map(str, got))


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixed(none).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert sorted(tuple(x) for x in M.mixed(blank).collect()) == [(1, None, 0, 0, 0.0, 0), (2, "a", 0, 0, 0.0, 0)]
