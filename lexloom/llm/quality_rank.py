"""op2: Bradley-Terry quality ranking.

Each text has FEATURES measurements (shares of symbols, capitals, repeated
words and lines, table bars and the like). A linear score over piecewise
linear functions of them is learnt from preference pairs: in each pair a text
labelled 1 is preferred to one labelled 0, with probability sigmoid(score
difference), by Newton steps on the logistic loss of feature differences.
The threshold is the quantile of training scores that splits off the share of
texts labelled 0; the published score is a logistic curve that is 0.3 there,
with the slope fitted on the same rows.

Training takes at most SAMPLE labelled rows (those whose hash of the id is
smallest), a documented bound: what is gathered does not grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

SAMPLE = 20_000
PAIRS = 40
KNOTS = 5
RIDGE = 1e-2
NAMES = ("log_words", "symbols", "capitals", "marks", "bars", "digits", "distinct", "repeats", "word_length", "lines", "repeated_lines", "long_words", "stops", "common")
FEATURES = len(NAMES)
_KIND = np.zeros(256, np.uint8)  # 1 symbol, 2 capital, 3 exclamation or question mark, 4 bar, 5 digit
for _k, _set in enumerate((b"#*$%&<>@^~_=+{}[]\\", bytes(range(65, 91)), b"!?", b"|", b"0123456789"), 1):
    _KIND[np.frombuffer(_set, np.uint8)] = _k


def measure(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Measurements (texts x FEATURES) of a segment's texts; all 0 for a text without words."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    low = textkit.lower(data)
    starts, ends, docs = textkit.word_spans(offsets, low)
    if not len(starts):
        return out
    words = np.bincount(docs, minlength=n).astype(float)
    per_word = np.maximum(words, 1)
    letters = np.bincount(docs, ends - starts, n)
    per_byte = np.maximum(letters, 1)
    kinds = _KIND[data]
    total = np.zeros((6, len(data) + 1), np.int32)
    for k in range(1, 6):
        np.cumsum(kinds == k, out=total[k, 1:])
    count = total[:, offsets[1:]] - total[:, offsets[:-1]]
    running = textkit.prefix_hash(low)
    hashes = textkit.range_hash(running, starts, ends)
    order = np.lexsort((hashes, docs))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (docs[order][1:] != docs[order][:-1])
    distinct = np.bincount(docs[order][new], minlength=n)
    run = np.diff(np.append(np.flatnonzero(new), len(order)))
    common = np.zeros(n)
    np.maximum.at(common, docs[order][new], run)
    again = np.zeros(len(docs), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_docs = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_docs + 1])
    line_hash = textkit.range_hash(running, line_starts, line_ends)
    lines = np.bincount(line_docs, minlength=n)
    pair = np.unique(np.stack([line_docs.astype(np.uint64), line_hash]), axis=1)[0].astype(np.int64) if len(line_docs) else line_docs
    distinct_lines = np.bincount(pair, minlength=n)
    last = low[ends - 1]
    out[:, 0] = np.log1p(words)
    for k in range(1, 6):
        out[:, k] = count[k] / per_byte
    out[:, 6] = distinct / per_word
    out[:, 7] = np.bincount(docs, again, n) / per_word
    out[:, 8] = letters / per_word
    out[:, 9] = lines / per_word
    out[:, 10] = (lines - distinct_lines) / np.maximum(lines, 1)
    out[:, 11] = np.bincount(docs, ends - starts > 12, n) / per_word
    out[:, 12] = np.bincount(docs, (last == 46) | (last == 44), n) / per_word
    out[:, 13] = common / per_word
    out[words == 0] = 0
    return out


class Ranking:
    """A Bradley-Terry score over piecewise linear features, and its calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.knots = np.quantile(x, np.linspace(0.02, 0.98, KNOTS), axis=0) if len(x) else np.zeros((KNOTS, FEATURES))
        z = self.expand(x)
        self.scale = np.maximum(z.std(0), 1e-6) if len(x) else np.ones(z.shape[1])
        self.center = z.mean(0) if len(x) else np.zeros(z.shape[1])
        z = (z - self.center) / self.scale
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.weight = np.zeros(z.shape[1])
        self.shift, self.slope = 0.0, 1.0
        if not len(good) or not len(bad):  # nothing to prefer: every text scores alike
            self.level = 0.95 if len(good) or not len(bad) else 0.05
            return
        self.level = None
        k = np.arange(PAIRS)[:, None]
        few = min(len(good), len(bad))
        a = good[(np.arange(few)[None] * 7919 + k * 104729) % len(good)].ravel()
        b = bad[(np.arange(few)[None] + k * 15485863) % len(bad)].ravel()
        d = z[a] - z[b]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(d @ self.weight, -30, 30)))
            gradient = d.T @ (1 - p) / len(d) - RIDGE * self.weight
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(d.shape[1]), gradient)
            self.weight += step
            if np.abs(step).max() < 1e-6:
                break
        s = z @ self.weight
        self.shift = float(np.quantile(s, len(bad) / len(y)))
        for _ in range(30):  # one-parameter logistic fit of the slope around the threshold
            f = self.slope * (s - self.shift) + np.log(0.3 / 0.7)
            p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            g = ((y - p) * (s - self.shift)).mean()
            h = (p * (1 - p) * (s - self.shift) ** 2).mean() + 1e-6
            self.slope = float(np.clip(self.slope + g / h, 0.05, 50))

    def expand(self, x: np.ndarray) -> np.ndarray:
        bends = [np.maximum(x - k, 0) for k in self.knots]
        return np.concatenate([x, x == 0, *bends], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.level is not None:
            return np.full(len(x), self.level)
        s = (self.expand(x) - self.center) / self.scale @ self.weight
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.shift) + np.log(0.3 / 0.7), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 0, sample: int = SAMPLE) -> Ranking:
    """Learn from labelled rows whose crc32(doc_id) mod 5 is not `fold`; at most about `sample` of them."""
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != fold)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if n > sample:  # rows by hash of their id, so that the bound holds for any table
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))

    def features(batches):
        for batch in batches:
            for lo, hi, offsets, data in textkit.segments(batch.column(2)):
                x = measure(offsets, data)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))], ["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").where("doc_id is not null").join(textkit.sized(known, 16), "doc_id").select("doc_id", "quality", "text")
    measured = rows.mapInArrow(features, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))  # one of the rows that share an id
    got = measured.collect()  # `sample` rows of FEATURES numbers
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return Ranking(np.array([r[2] for r in got]).reshape(-1, FEATURES), np.array([r[1] for r in got]))


def quality_scores(docs: DataFrame, labels: DataFrame, fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 is likelier), predicted (1 if score >= threshold).

    One row for each row with a doc_id; rows without one are left out,
    repeated rows give one row each (of rows that share a doc_id, training
    takes the one of least measurements). Null and empty texts have all
    measurements 0 and get a score like any other. Without labels of both
    kinds all scores are alike. Other columns, and labels, never enter a score.
    """
    spark = docs.sparkSession
    textkit.on_workers(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, fold))

    def work(batches):
        ranking = shared.value
        for batch in batches:
            for lo, hi, offsets, data in textkit.segments(batch.column(1)):
                s = ranking.score(measure(offsets, data))
                ids = batch.column(0).slice(lo, hi - lo)
                held = [textkit.crc_mod(k, 5) == fold for k in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def op2_bradley_terry_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(textkit.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
