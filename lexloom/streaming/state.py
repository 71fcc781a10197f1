"""The tables of graded feedback kept as state of a stream, in the order of event time.

Events: ts (milliseconds since 1970, over 0), q, text, source, compose (array), label
('good', 'bad', or another for events that only move the time on). An event is
held until the watermark, `late` behind the newest event, has passed it; a key's
events then fold in the order of ts. So the result doesn't depend on how the
events fall into micro-batches, and a query that is stopped and started again
from its checkpoint goes on where it was. Events later than `late` are dropped.

Streams append a row for each change; `current` gives the table that batch
operators give for the same events.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import text as T
from ..operators import feedback as B

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keys that the events of a pool are dealt to; each keeps as many as the pool.
SHARDS = 16
#: Keys that terms are dealt to; a setting of the state, so it must stay as it is over restarts.
TERM_SHARDS = 1024


def timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", late)


def _only(condition):
    """A filter that stays above the watermark, so that all events move the time on."""
    return F.when(F.col("time").isNotNull(), condition)


def _folded(code: np.ndarray, d: np.ndarray, w: np.ndarray) -> None:
    """w[c] folded over the steps d of each code c; rows are in the order of code, then of time. Neighbouring steps of a code compose, so each round halves them."""
    add, low, high = d.astype(float), np.full(len(d), B.BASE_TERM), np.full(len(d), B.MAX_TERM)
    while len(code) and (code[1:] == code[:-1]).any():
        place = np.arange(len(code)) - np.searchsorted(code, code)
        one = np.flatnonzero(place % 2 == 0)
        two = np.minimum(one + 1, len(code) - 1)
        pair = (two > one) & (code[two] == code[one])
        f, g = one[pair], two[pair]
        low[f], high[f] = (np.maximum(low[g], np.minimum(high[g], x[f] + add[g])) for x in (low, high))
        add[f] += add[g]
        code, add, low, high = code[one], add[one], low[one], high[one]
    w[code] = np.maximum(low, np.minimum(high, w[code] + add))


def stream_ordered_weights(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(term, ts, w) whenever a term's weight has folded up to ts. Terms are dealt to TERM_SHARDS keys; a shard's state has the weights of its terms and the steps that wait."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    change = F.when(F.col("label") == "good", F.lit(B.REWARD)).when(F.col("label") == "bad", F.lit(-B.DECAY))
    rows = timed(events, late).where(_only(F.col("label").isin("good", "bad"))).select("time", "ts", change.alias("d"), F.explode(F.array_distinct(T.terms(F.coalesce("q", F.lit(""))))).alias("term"))
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(TERM_SHARDS)).cast("int"))
    kinds = (np.float64, np.int32, np.int64, np.float64)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        terms, w, *held = pa.array([], pa.string()), *(np.zeros(0, k) for k in kinds)
        if state.exists:
            names, *arrays = state.get
            terms, (w, *held) = pa.array(names, pa.string()), (np.frombuffer(x, k).copy() for x, k in zip(arrays, kinds))
        parts = [held]
        if not state.hasTimedOut:
            for b in batches:
                own = pa.array(b["term"], pa.string())
                distinct = own.unique()
                terms = pa.concat_arrays([terms, distinct.filter(pc.is_null(pc.index_in(distinct, value_set=terms)))])
                parts.append([pc.index_in(own, value_set=terms).to_numpy(), b["ts"].to_numpy(), b["d"].to_numpy()])
        code, ts, d = (np.concatenate(x) for x in zip(*parts))
        w = np.append(w, np.full(len(terms) - len(w), B.BASE_TERM))
        mark = state.getCurrentWatermarkMs()
        now = ts <= mark
        if now.any():
            order = np.flatnonzero(now)[np.lexsort((d[now], ts[now], code[now]))]
            _folded(code[order], d[order], w)
            last = np.flatnonzero(np.append(code[order][1:] != code[order][:-1], True))
            changed = code[order][last]
            yield pd.DataFrame({"term": terms.take(pa.array(changed)).to_pandas(), "ts": ts[order][last], "w": w[changed]})
        code, ts, d = code[~now], ts[~now], d[~now]
        state.update((terms.to_pylist(), *(x.astype(k).tobytes() for x, k in zip((w, code, ts, d), kinds))))
        if len(ts):
            state.setTimeoutTimestamp(max(int(ts.min()), mark + 1))

    return sharded.groupBy("shard").applyInPandasWithState(fold, "term string, ts long, w double", "terms array<string>, w binary, code binary, ts binary, d binary", "append", GroupStateTimeout.EventTimeTimeout)


class BlockedSets(StatefulProcessor):
    """The last parts of a question's rejected answers; events wait in a map by time, with a timer each."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "ts long", "parts array<array<string>>")
        self.blocked = handle.getValueState("blocked", "parts array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for ts, parts in zip(batch["ts"].tolist(), batch["parts"].tolist()):
                there = [list(p) for p in self.held.getValue((ts,))[0]] if self.held.containsKey((ts,)) else []
                self.held.updateValue((ts,), ([*there, list(parts)],))
                self.handle.registerTimer(ts)
        yield pd.DataFrame({"sig": pd.Series([], dtype=str), "ts": pd.Series([], dtype="int64"), "blocked": pd.Series([], dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = [ts for (ts,) in self.held.keys() if ts <= timerValues.getCurrentWatermarkInMs()]  # what a first timer has folded, later ones don't find
        if now:
            blocked = list(self.blocked.get()[0]) if self.blocked.exists() else []
            for ts in sorted(now):
                for parts in sorted(list(p) for p in self.held.getValue((ts,))[0]):
                    blocked = B.blocked_step(blocked, parts)
                self.held.removeKey((ts,))
            self.blocked.update((blocked,))
            yield pd.DataFrame({"sig": [key[0]], "ts": [max(now)], "blocked": [blocked]})

    def close(self) -> None:
        pass


def stream_blocked_sets(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(sig, ts, blocked) whenever a question's set has folded up to ts."""
    rows = timed(events, late).where(_only(F.col("label") == "bad")).select("time", "ts", T.signature(F.col("q")).alias("sig"), B.blocked_parts().alias("parts"))
    return _with_rocks(rows).groupBy("sig").transformWithStateInPandas(BlockedSets(), "sig string, ts long, blocked array<string>", "append", "eventTime")


class Pools(StatefulProcessor):
    """The times of the last rows of a pool's shard; rows that are among them when they come are passed on."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "ts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        size = {"events": B.MAX_EVENTS, "accepted": B.MAX_ACCEPTED, "rejected": B.MAX_REJECTED}[key[0]]
        last = [int(x) for x in self.last.get()[0]] if self.last.exists() else []
        heapq.heapify(last)
        for batch in rows:
            enters = []
            for ts in batch["ts"].tolist():
                enters.append(len(last) < size or ts >= last[0])
                heapq.heappush(last, ts)
                if len(last) > size:
                    heapq.heappop(last)
            yield batch.loc[enters, ["pool", "ts", "q", "text", "source", "label"]]
        self.last.update((last,))

    def close(self) -> None:
        pass


def stream_pools(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(pool, ts, q, text, source, label): rows that enter the pools `events`, `accepted` and `rejected`; a pool's state is dealt to SHARDS keys, each with as many times as the pool has rows."""
    text = F.coalesce("text", F.lit("")) != ""
    pools = F.filter(F.array(F.lit("events"), F.when((F.col("label") == "good") & text, F.lit("accepted")), F.when((F.col("label") == "bad") & text, F.lit("rejected"))), lambda x: x.isNotNull())
    rows = timed(events, late).where(_only(F.col("label").isin("good", "bad"))).select("time", "ts", "q", "text", "source", "label", F.explode(pools).alias("pool"))
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("ts"), F.lit(SHARDS)).cast("int"))
    return _with_rocks(keyed).groupBy("pool", "shard").transformWithStateInPandas(Pools(), "pool string, ts long, q string, text string, source string, label string", "append", "eventTime")


def stream_stats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(label, n) of all events so far; for update mode."""
    return timed(events, late).where(_only(F.col("label").isin("good", "bad"))).groupBy("label").agg(F.count("*").alias("n"))


def _with_rocks(rows: DataFrame) -> DataFrame:
    rows.sparkSession.conf.set(_STORE, _ROCKS)  # map state and timers need it
    return rows


def advance(stream: DataFrame, folder: str) -> None:
    """Fold all events there are now into the table of `folder`, from where an earlier call stopped."""
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def appended(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/table")


def current(changes: DataFrame, *keys: str) -> DataFrame:
    """The last change of each key."""
    others = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*others), "ts").alias("last")).select(*keys, *(F.col(f"last.{c}") for c in others))


def current_pool(entered: DataFrame, pool: str) -> DataFrame:
    """The pool as the batch operators give it."""
    size = {"events": B.MAX_EVENTS, "accepted": B.MAX_ACCEPTED, "rejected": B.MAX_REJECTED}[pool]
    return B.latest(entered.where(F.col("pool") == pool), size).drop("pool")
