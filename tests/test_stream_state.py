"""Feedback as state of a stream: any split into micro-batches, late events and a restart give the tables of the batch operators."""

import random

import pytest

from lexloom.operators import feedback as B
from lexloom.streaming import state as S

SCHEMA = "ts long, q string, text string, source string, compose array<string>, label string"
HOUR = 3_600_000


def events(n=320):
    r = random.Random(8)
    words = ["gear", "shaft", "bearing", "weld", "歯車", "軸受"]
    out = []
    for k in range(n):
        q = " ".join(r.choice(words) for _ in range(r.randint(0, 3)))
        text = r.choice([None, "", *(f"Answer number {r.randint(0, 90)} holds. And part {r.randint(0, 90)} too!" for _ in range(8))])
        compose = r.choice([None, [], [f"piece {r.randint(0, 200)}" for _ in range(r.randint(1, 40))]])
        out.append((k * 60_000 + 5, q, text, "kb", compose, "good" if r.random() < 0.4 else "bad"))
    return out


def tick(ts):
    return [(ts, None, None, None, None, "tick")]


def feed(spark, folder, parts):
    for p in parts:
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def split(rows, seed):
    """Micro-batches with events up to half an hour out of order."""
    r = random.Random(seed)
    order = sorted(rows, key=lambda e: e[0] + r.randint(0, HOUR // 2))
    cuts = sorted(r.sample(range(1, len(rows)), 3))
    return [order[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


@pytest.fixture(scope="module")
def batch(spark):
    table = spark.createDataFrame(events(), SCHEMA).repartition(3).cache()
    return {
        "weights": {r.term: r.w for r in B.term_weights(table).collect()},
        "blocked": {r.sig: list(r.blocked) for r in B.blocked_sets(table).collect()},
        "pools": {p: sorted(r.ts for r in f(table).collect()) for p, f in (("events", B.event_log), ("accepted", B.accepted_pool), ("rejected", B.rejected_pool))},
    }


def plain_blocked(rows):
    """The sets by folding all events in a loop."""
    out = {}
    for sig, parts in rows:
        have = out.setdefault(sig, [])
        for p in parts:
            if p and p not in have:
                have.append(p)
        out[sig] = have[-50:]
    return {k: v for k, v in out.items() if v}


def test_blocked_sets_fold_in_order(spark, batch):
    """Parts that fell out of a set come back; sets of more than 50 parts occur."""
    table = spark.createDataFrame(events(), SCHEMA)
    rows = table.where("label = 'bad'").select("ts", S.T.signature(S.F.col("q")).alias("sig"), B.blocked_parts().alias("parts")).orderBy("ts").collect()
    assert batch["blocked"] == plain_blocked((r.sig, list(r.parts)) for r in rows)
    seen = {}
    for r in rows:
        seen.setdefault(r.sig, set()).update(r.parts)
    assert max(map(len, seen.values())) > 100 and max(map(len, batch["blocked"].values())) == 50
    assert B.blocked_sets(table.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_a_restart_give_the_batch_tables(spark, tmp_path, batch, monkeypatch, seed):
    monkeypatch.setattr(B, "MAX_ACCEPTED", 30)
    parts = split(events(), seed)
    makers = {"weights": S.stream_ordered_weights, "blocked": S.stream_blocked_sets, "pools": S.stream_pools}
    feed(spark, tmp_path, parts[:2])
    for name, f in makers.items():
        S.advance(f(stream(spark, tmp_path)), f"{tmp_path}/{name}")
    feed(spark, tmp_path, [*parts[2:], tick(events()[-1][0] + 2 * HOUR)])
    for name, f in makers.items():
        S.advance(f(stream(spark, tmp_path)), f"{tmp_path}/{name}")
    weights = S.current(S.appended(spark, f"{tmp_path}/weights", "term string, ts long, w double"), "term")
    assert {r.term: r.w for r in weights.collect()} == batch["weights"]
    blocked = S.current(S.appended(spark, f"{tmp_path}/blocked", "sig string, ts long, blocked array<string>"), "sig").collect()
    assert {r.sig: list(r.blocked) for r in blocked if r.blocked} == batch["blocked"]
    entered = S.appended(spark, f"{tmp_path}/pools", "pool string, ts long, q string, text string, source string, label string")
    assert sorted(r.ts for r in S.current_pool(entered, "events").collect()) == batch["pools"]["events"]
    assert sorted(r.ts for r in S.current_pool(entered, "rejected").collect()) == batch["pools"]["rejected"]
    assert sorted(r.ts for r in S.current_pool(entered, "accepted").collect()) == batch["pools"]["accepted"][-30:]


def test_events_wait_for_the_watermark_and_very_late_ones_go(spark, tmp_path):
    one = [(10 * HOUR, "gear", "An answer here.", "kb", None, "good")]
    feed(spark, tmp_path, [one])
    S.advance(S.stream_ordered_weights(stream(spark, tmp_path)), f"{tmp_path}/w")
    table = S.appended(spark, f"{tmp_path}/w", "term string, ts long, w double")
    assert table.count() == 0  # the watermark is an hour behind
    feed(spark, tmp_path, [tick(12 * HOUR), [(5 * HOUR, "gear", None, "kb", None, "bad"), (11 * HOUR + 1, "gear", None, "kb", None, "good")], tick(20 * HOUR)])
    S.advance(S.stream_ordered_weights(stream(spark, tmp_path)), f"{tmp_path}/w")
    table = S.appended(spark, f"{tmp_path}/w", "term string, ts long, w double")
    assert [tuple(r) for r in S.current(table, "term").collect()] == [("gear", 11 * HOUR + 1, 2.0)]


def test_counts(spark, tmp_path):
    feed(spark, tmp_path, split(events(), 3))
    q = S.stream_stats(stream(spark, tmp_path)).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.label: r.n for r in spark.sql("select label, max(n) as n from counts group by label").collect()}
    [want] = B.stats(spark.createDataFrame(events(), SCHEMA)).collect()
    assert last == {"good": want.good, "bad": want.bad}


def test_steps_fold_by_halves():
    """Composed steps of many codes equal a loop over them."""
    r = random.Random(5)
    code = sorted(r.choices(range(9), range(1, 10), k=700))
    d = [r.choice([B.REWARD, -B.DECAY]) for _ in code]
    want = [1.0, 2.5, 3.0] * 3
    got = S.np.array(want)
    for c, x in zip(code, d):
        want[c] = max(B.BASE_TERM, min(B.MAX_TERM, want[c] + x))
    S._folded(S.np.array(code), S.np.array(d), got)
    assert got.tolist() == want


def test_many_terms_share_a_key(spark, tmp_path):
    """A key for each term would make the time of a micro-batch grow with the vocabulary."""
    (tmp_path / "in").mkdir()
    plan = S.stream_ordered_weights(stream(spark, tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(term" in plan
