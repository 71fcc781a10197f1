"""op6, op9 and op10 against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

from lexloom.llm import components, factors, jaccard, site_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_removal(rows, length, keep_first=False):
    count, first = collections.Counter(), {}
    texts = [(k, t.encode()) for k, t in sorted(rows)]
    for n, (_, b) in enumerate(texts):
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
            first.setdefault(b[i : i + length], (n, i))
    out = []
    for n, (k, b) in enumerate(texts):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if count[s] > 1 and not (keep_first and first[s] == (n, i)):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_op6(docs, none, known):
    got = factors.deduplicate(docs, 400).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute_removal(known, 400)
    assert factors.deduplicate(none).count() == 0


@pytest.mark.parametrize("crowd", [20_000, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_of_short_strings(spark, crowd, keep_first):
    r = random.Random(3)
    base = ["".join(r.choice("ab") for _ in range(60)) for _ in range(6)]
    rows = [(k, "".join(r.choice(base) for _ in range(r.randint(0, 4)))) for k in range(50)] + [(101, ""), (102, "a" * 50)]
    got = factors.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 20, keep_first, 8, crowd).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute_removal(rows, 20, keep_first)


@pytest.mark.parametrize("depth", [3, 8, 20, 40])
def test_factors(depth):
    r = random.Random(4)
    for _ in range(40):
        s = bytes(r.choice(b"ab") for _ in range(r.randint(depth, 120)))
        at = np.array(sorted(r.sample(range(len(s) - depth + 1), r.randint(1, len(s) - depth + 1))))
        earlier, later = factors.factors(np.frombuffer(s, np.uint8), at, depth)

        def match(i, j):
            return next((k for k in range(depth) if s[i + k] != s[j + k]), depth)

        for k, i in enumerate(at.tolist()):
            assert earlier[k] == max((match(i, j) for j in at[:k].tolist()), default=0)
            assert later[k] == max((match(i, j) for j in at[k + 1 :].tolist()), default=0)


def test_neighbours():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 50):
        for values in (r.permutation(n), np.arange(n), np.arange(n)[::-1]):
            before, after = factors.neighbours(values)
            for k in range(n):
                assert before[k] == max((j for j in range(k) if values[j] < values[k]), default=-1)
                assert after[k] == min((j for j in range(k + 1, n) if values[j] < values[k]), default=n)


def brute_groups(rows):
    sets = []
    for k, t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets.append((k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def test_op10(docs, none, known):
    assert sorted(map(tuple, jaccard.jaccard_groups(docs).collect())) == brute_groups(known)
    assert jaccard.jaccard_groups(none).count() == 0


def mixed(r, n):
    """Texts at all distances from each other: near copies, halves in common, and some that share a few shingles."""
    base = [[f"w{r.randrange(500)}" for _ in range(60)] for _ in range(4)]
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(900)}"
        yield " ".join(w + r.choice(base)[: r.randint(0, 40)])


@pytest.mark.parametrize("cell", [60, 300, 1500])
def test_regions_of_several_parts(spark, cell):
    r = random.Random(cell)
    rows = list(enumerate(mixed(r, 80)))
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_parts_of_a_region_far_from_its_pivot(spark):
    """A crowd that shares a passage and no more: parts, rings and windows must find the few links."""
    r = random.Random(11)
    passage = [f"p{k}" for k in range(40)]
    own = [[f"q{r.randrange(10**6)}" for _ in range(12)] for _ in range(30)]
    rows = [(k, " ".join(passage + own[k % 30] + ([f"z{k}"] if k % 3 else []))) for k in range(60)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), cell=200).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_active_members_alone():
    r = np.random.default_rng(2)
    for _ in range(20):
        base = r.integers(0, 1 << 60, 40).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[: r.integers(25, 40)], r.integers(0, 1 << 60, r.integers(0, 6)).astype(np.uint64)])) for _ in range(20)]
        active = r.random(20) < 0.3
        roots = jaccard.join_region(sets, active=active)
        for i in range(20):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if (active[i] or active[j]) and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                    assert roots[i] == roots[j]


def test_regions_join_exactly():
    r = np.random.default_rng(1)
    for _ in range(10):
        base = [r.integers(0, 1 << 60, 60).astype(np.uint64) for _ in range(5)]
        sets = []
        for _ in range(50):
            b = base[r.integers(5)].copy()
            k = r.integers(0, 25)
            b[:k] = r.integers(0, 1 << 60, k).astype(np.uint64)
            sets.append(np.unique(b if r.random() < 0.7 else np.concatenate([b[:40], base[r.integers(5)][: r.integers(0, 30)]])))
        up = list(range(50))

        def find(k):
            while up[k] != k:
                k = up[k]
            return k

        for i in range(50):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        assert jaccard.join_region(sets) == [find(k) for k in range(50)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 12)] + [(20, 21), (21, 22), (22, 20), (30, 30)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(1, 13)} | {20: 20, 21: 20, 22: 20}


def brute_lines(rows, sites, least):
    seen, first = collections.defaultdict(set), {}
    for k, t, s in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((t or "").split("\n")):
            core = line.strip(" \t\n\x0b\x0c\r")
            if len(core) >= least:
                seen[core].add(s or "")
                first.setdefault(core, (k, n))
    out = []
    for k, t, _ in rows:
        lines = (t or "").split("\n")
        cores = [line.strip(" \t\n\x0b\x0c\r") for line in lines]
        kept = [line for n, (line, c) in enumerate(zip(lines, cores)) if not (len(c) >= least and len(seen[c]) >= sites and first[c] != (k, n))]
        out.append((k, 0 if not t else len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_op9(spark, docs, none, rows):
    lines = ["a line that stands on many sites", "short", " a line that stands on many sites ", "another line on a few sites"]
    many = [(k, f"own text number {k} of this test\n{lines[0] if k % 2 else lines[2]}\n{lines[1]}\n{lines[3] if k < 3 else ''}", f"s{k}") for k in range(14)]
    many += [(20, None, "s1"), (21, "", "s1"), (22, lines[0] + "\n" + lines[0], None), (22, lines[0] + "\n" + lines[0], None)]
    got = site_lines.without_shared_lines(spark.createDataFrame(many, "doc_id long, text string, source string"), 10, 16)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute_lines(many, 10, 16)
    kept = [r for r in rows if r[0] is not None]
    got = site_lines.without_shared_lines(docs, 2, 16).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(kept, 2, 16)
    assert site_lines.without_shared_lines(none).count() == 0


def roots_of_all_pairs(sets, num=75, den=100):
    """The first member of each component, by comparing all pairs as an incidence matrix."""
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.zeros((len(sets), int(column.max()) + 1), np.float32)
    rows[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column] = 1
    common, size = rows @ rows.T, rows.sum(axis=1)
    linked = den * common >= num * (size[:, None] + size - common)
    root = np.arange(len(sets))
    while True:
        least = np.where(linked, root, len(sets)).min(axis=1)
        if (least == root).all():
            return root.tolist()
        root = least


@pytest.mark.parametrize("seed", range(4))
def test_crowds_that_share_a_passage(seed):
    """Members share 20 to 60 of their shingles with all others; own ones are alone, from a pool, or of near copies."""
    r = np.random.default_rng(seed)
    core, pool = r.integers(1, 1 << 63, 60, dtype=np.uint64), r.integers(1, 1 << 63, 700, dtype=np.uint64)
    sets = []
    for _ in range(500):
        own = r.integers(1, 1 << 63, r.integers(0, 40), dtype=np.uint64) if r.random() < 0.5 else r.choice(pool, r.integers(1, 40))
        sets.append(np.unique(np.concatenate((core[: r.integers(20, 61)], own))))
        if r.random() < 0.3:
            near = np.delete(sets[-1], r.choice(len(sets[-1]), len(sets[-1]) // r.integers(4, 9), replace=False))
            sets.append(np.unique(np.concatenate((near, r.integers(1, 1 << 63, r.integers(0, 4), dtype=np.uint64)))))
    order = r.permutation(len(sets))
    sets = [sets[k] for k in order]
    assert jaccard.join_region(sets) == roots_of_all_pairs(sets)
    active = r.random(len(sets)) < 0.5
    some = jaccard.join_region(sets, active=active)
    assert len(set(some)) >= len(set(roots_of_all_pairs(sets)))
    assert jaccard.join_region(sets, 1, 2) == roots_of_all_pairs(sets, 1, 2)


def test_a_crowd_without_links_costs_little():
    r = np.random.default_rng(9)
    core = r.integers(1, 1 << 63, 30, dtype=np.uint64)
    sets = [np.unique(np.concatenate((core, r.integers(1, 1 << 63, 10, dtype=np.uint64)))) for _ in range(4000)]
    began = time.process_time()
    assert len(set(jaccard.join_region(sets))) == 4000
    assert time.process_time() - began < 5


def test_documents_that_share_a_passage(spark):
    """The whole operator over many texts with one passage in common, near copies among them."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(1500):
        own = [word() for _ in range(r.randint(4, 60))]
        rows.append((k, " ".join(own[: len(own) // 2] + passage[: r.choice([40, 60])] + own[len(own) // 2 :])))
        if k % 10 == 0:
            near = rows[-1][1].split()
            near[r.randrange(len(near))] = "changed"
            rows.append((5000 + k, " ".join(near)))
    found = {x.doc_id: x.component_id for x in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), cell=3000).collect()}
    shingles = lambda t: {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}
    numbers: dict[str, int] = {}
    sets = [np.array(sorted(numbers.setdefault(g, len(numbers)) for g in shingles(t.split())), np.uint64) for _, t in rows]
    roots, ids = roots_of_all_pairs(sets), [k for k, _ in rows]
    least = {}
    for k, root in zip(ids, roots):
        least[root] = min(k, least.get(root, k))
    assert found == {k: least[root] for k, root in zip(ids, roots)}
