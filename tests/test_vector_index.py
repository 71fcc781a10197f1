"""The inverted-file index against brute force: exact search, recall, groups of any size, odd rows, more rows, a loaded index."""

import math

import numpy as np
import pytest

from lexloom.operators import embed
from lexloom.operators import vector_index as X


def vectors(n, dim=16, clusters=12, seed=1, spread=0.35):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    return (centres[r.integers(0, clusters, n)] + spread * r.normal(size=(n, dim))).tolist()


def table(spark, rows, key="item_id"):
    return spark.createDataFrame(rows, f"{key} long, v array<double>")


def hits(df):
    return sorted((r.qid, r["rank"], r.item_id, round(r.cos, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    v = vectors(900)
    return [(k, x) for k, x in enumerate(v)] + [(2000 + k, v[5]) for k in range(300)] + [(3000 + k, [0.0] * 16) for k in range(4)]


@pytest.fixture(scope="module")
def odd():
    return [(None, [1.0] * 16), (4000, None), (4001, [1.0, 2.0]), (4002, [math.nan] * 16), (4003, [None] * 16), (4004, [])]


@pytest.fixture(scope="module")
def asked(rows):
    """Rows, new vectors, a zero vector and vectors that can't be asked for."""
    return [(k, v) for k, v in rows[::100]] + [(5000 + k, v) for k, v in enumerate(vectors(6, seed=9))] + [(6000, [0.0] * 16), (6001, [-1.0] * 16)]


@pytest.fixture(scope="module")
def index(spark, rows, odd):
    return X.VectorIndex.build(table(spark, rows + odd).repartition(5), cells=20)


def test_exact_search_is_brute_force(spark, index, rows, odd, asked):
    want = hits(embed.nearest(table(spark, asked, "qid"), table(spark, rows), 7))
    queries = table(spark, asked + odd, "qid")
    assert hits(index.search(queries, 7)) == want
    assert hits(index.search(queries, 7, probes=20)) == want
    assert hits(X.VectorIndex.load(spark, index.path).search(queries, 7)) == want


def test_groups_of_any_size(spark, index, rows, asked, monkeypatch):
    """300 equal rows are in one cell: it is dealt to many groups, and so are its queries."""
    monkeypatch.setattr(X, "PART", 40)
    monkeypatch.setattr(X, "QUERY_PART", 2)
    assert hits(index.search(table(spark, asked, "qid"), 7)) == hits(embed.nearest(table(spark, asked, "qid"), table(spark, rows), 7))


def test_few_probes_find_most(spark, index, rows):
    queries = table(spark, [(k, v) for k, v in rows[:900:9]], "qid")
    true = embed.nearest(queries, table(spark, rows), 5)
    probes = index.probes_for(5)
    assert probes < 10
    [found] = X.recall_at(index.search(queries, 5, probes), true).collect()
    assert found.queries == 100 and found.pairs == 500 and found.recall >= 0.9
    [all_] = X.recall_at(true, true).collect()
    assert all_.recall == 1.0


def test_every_row_is_in_one_cell_and_more_can_come(spark, rows):
    index = X.VectorIndex.build(table(spark, rows[:600]), cells=9, rounds=3)
    index.add(table(spark, rows[600:]))
    assert sorted(r.item_id for r in index.rows().select("item_id").collect()) == sorted(k for k, _ in rows)
    queries = [(k, v) for k, v in rows[::150]]
    assert hits(index.search(table(spark, queries, "qid"), 3)) == hits(embed.nearest(table(spark, queries, "qid"), table(spark, rows), 3))


def test_probed_cells_alone_are_read(spark, index, rows):
    found = index.search(table(spark, rows[:1], "qid"), 5, probes=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_centres_do_not_depend_on_the_partitions(spark, rows):
    one, many = (X.fitted_centres(table(spark, rows).repartition(n), 6) for n in (1, 7))
    assert np.allclose(one, many)


def test_nothing(spark, rows):
    none = X.VectorIndex.build(table(spark, []))
    assert none.search(table(spark, rows[:3], "qid"), 3).collect() == [] and none.probes_for() == 1
    zeros = X.VectorIndex.build(table(spark, [(1, [0.0, 0.0]), (2, [0.0, 0.0])]))
    assert hits(zeros.search(table(spark, [(9, [1.0, 0.0])], "qid"), 5)) == [(9, 1, 1, 0.0), (9, 2, 2, 0.0)]
    assert zeros.search(table(spark, [], "qid"), 5).collect() == []
    with pytest.raises(ValueError):
        embed.nearest(table(spark, [(1, [0.0] * 4_000_000)], "qid"), table(spark, rows))
