"""A small neural language model: embedded contexts, one tanh layer, softmax over the most frequent tokens.

Training is data-parallel: in each step the partitions of one bucket of texts
sum their gradients, the sums are added block by block in further tasks, and
the driver, which holds nothing but the weights, moves them (Adam). Tokens
beyond the vocabulary, and what stands before a text, have id 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import one_thread, written, written_path

# --- fixed values: context, embedding and hidden sizes, most tokens, least tokens beyond a context ---
CONTEXT, DIM, HIDDEN, VOCABULARY, LEAST = 3, 24, 64, 480, 5
# --- end of fixed values ---
#: Tokens of a step and of a task of it, most buckets of texts, positions worked on at once, and blocks that gradients are added in.
STEP_TOKENS, TASK_TOKENS, BUCKETS, CHUNK, BLOCKS = 1 << 16, 1 << 13, 1024, 2048, 4
_NAMES = ("embedding", "hidden", "hidden_bias", "out", "out_bias")


@dataclass
class NeuralLM:
    tokens: list[str]  # tokens[k] has id k + 1
    weights: list[np.ndarray]
    steps: int = 0
    losses: list[float] = field(default_factory=list)  # mean over the tokens of each step, in nats

    @classmethod
    def fresh(cls, tokens: list[str], context: int = CONTEXT, dim: int = DIM, hidden: int = HIDDEN, seed: int = 0) -> NeuralLM:
        r, v = np.random.default_rng(seed), len(tokens) + 1
        return cls(tokens, [0.1 * r.standard_normal((v, dim)), r.standard_normal((context * dim, hidden)) / np.sqrt(context * dim), np.zeros(hidden), 0.1 * r.standard_normal((hidden, v)), np.zeros(v)])

    @property
    def context(self) -> int:
        return self.weights[1].shape[0] // self.weights[0].shape[1]

    def warm_started(self, old: NeuralLM) -> NeuralLM:
        """These tokens with the weights of another model of the same sizes; tokens that it doesn't know keep their own."""
        known = {t: k + 1 for k, t in enumerate(old.tokens)}
        mine = [0, *(k + 1 for k, t in enumerate(self.tokens) if t in known)]
        theirs = [0, *(known[t] for t in self.tokens if t in known)]
        e, _, _, o, ob = (w.copy() for w in self.weights)
        e[mine], o[:, mine], ob[mine] = old.weights[0][theirs], old.weights[3][:, theirs], old.weights[4][theirs]
        return NeuralLM(self.tokens, [e, old.weights[1].copy(), old.weights[2].copy(), o, ob], old.steps)

    def encode(self, tokens: list[str]) -> np.ndarray:
        ids = {t: k + 1 for k, t in enumerate(self.tokens)}
        return np.array([ids.get(t, 0) for t in tokens], np.int64)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n, list(w.shape), w.ravel().tolist(), self.tokens, self.steps, self.losses) for n, w in zip(_NAMES, self.weights)]
        spark.createDataFrame(rows, "name string, shape array<int>, values array<double>, tokens array<string>, steps long, losses array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeuralLM:
        rows = {r.name: r for r in spark.read.parquet(path).collect()}
        first = rows[_NAMES[0]]
        return cls(list(first.tokens), [np.array(rows[n]["values"]).reshape(rows[n].shape) for n in _NAMES], first.steps, list(first.losses))


def windows(ids: np.ndarray, context: int) -> np.ndarray:
    """The ids before each position, zeros before the first."""
    padded = np.concatenate((np.zeros(context, np.int64), ids))
    return np.lib.stride_tricks.sliding_window_view(padded[:-1], context) if len(ids) else np.zeros((0, context), np.int64)


def log_probs(weights: list[np.ndarray], contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, hidden layer, log probabilities of all ids) of contexts."""
    e, w, b, o, ob = weights
    x = e[contexts].reshape(len(contexts), -1)
    h = np.tanh(x @ w + b)
    z = h @ o + ob
    z -= z.max(axis=1, keepdims=True)
    return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradient(weights: list[np.ndarray], contexts: np.ndarray, targets: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(loss, its gradients), summed over the positions."""
    e, w, _, o, _ = weights
    x, h, logp = log_probs(weights, contexts)
    at = np.arange(len(targets))
    d = np.exp(logp)
    d[at, targets] -= 1
    dh = (d @ o.T) * (1 - h * h)
    de = np.zeros_like(e)
    np.add.at(de, contexts.ravel(), (dh @ w.T).reshape(-1, e.shape[1]))
    return -float(logp[at, targets].sum()), [de, x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The most frequent tokens (equal ones in order), one less than `size`."""
    tokens = texts.select(F.explode(T.lm_tokens(F.coalesce("text", F.lit("")))).alias("tok"))
    return [r.tok for r in tokens.groupBy("tok").count().orderBy(F.desc("count"), "tok").limit(size - 1).collect()]


class Examples:
    """Texts as ids, written in buckets by a hash of the text; a step reads one bucket."""

    def __init__(self, texts: DataFrame, model: NeuralLM):
        spark = texts.sparkSession
        one_thread(spark)
        shared = spark.sparkContext.broadcast(model)

        def encode(batches):
            lookup = {t: k + 1 for k, t in enumerate(shared.value.tokens)}
            for batch in batches:
                ids = pa.array([[lookup.get(t, 0) for t in row] for row in batch.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["h", "ids"])

        text = F.coalesce("text", F.lit(""))
        encoded = written(texts.select(F.xxhash64(text).alias("h"), T.lm_tokens(text).alias("tokens")).where(F.size("tokens") > 0).mapInArrow(encode, "h long, ids array<int>"))
        self.n_tokens = encoded.agg(F.sum(F.size("ids"))).first()[0] or 0
        self.n_buckets = min(BUCKETS, max(1, self.n_tokens // STEP_TOKENS))
        files = -(-self.n_tokens // (self.n_buckets * 64 * STEP_TOKENS)) or 1  # of a bucket
        self.path = written_path(spark)
        dealt = encoded.withColumn("bucket", F.pmod("h", F.lit(self.n_buckets)).cast("int")).withColumn("deal", F.pmod(F.shiftright("h", 20), F.lit(files)))
        dealt.repartition("bucket", "deal").select("ids", "bucket").write.partitionBy("bucket").parquet(self.path)
        self.spark = spark

    def bucket(self, k: int) -> DataFrame:
        return self.spark.read.schema("ids array<int>, bucket int").parquet(self.path).where(F.col("bucket") == k % self.n_buckets).select("ids").repartition(-(-self.n_tokens // (self.n_buckets * TASK_TOKENS)))


def total_gradient(examples: DataFrame, weights: list[np.ndarray]) -> tuple[int, float, np.ndarray]:
    """(positions, loss, flat gradient) summed over all examples (ids): partitions sum theirs, and blocks of them are added in tasks."""
    shared = examples.sparkSession.sparkContext.broadcast(weights)
    context, schema = weights[1].shape[0] // weights[0].shape[1], "block int, n long, loss double, part binary"

    def sums(batches):
        total, n, loss = None, 0, 0.0
        for batch in batches:
            rows = [np.array(r, np.int64) for r in batch.column(0).to_pylist()]
            contexts, targets = np.concatenate([windows(r, context) for r in rows]), np.concatenate(rows)
            for k in range(0, len(targets), CHUNK):
                one, grads = gradient(shared.value, contexts[k : k + CHUNK], targets[k : k + CHUNK])
                flat = np.concatenate([g.ravel() for g in grads])
                total, n, loss = flat if total is None else total + flat, n + len(targets[k : k + CHUNK]), loss + one
        if total is not None:
            for k, part in enumerate(np.array_split(total, BLOCKS)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n]), pa.array([loss]), pa.array([part.tobytes()], pa.binary())], ["block", "n", "loss", "part"])

    def added(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for block, n, loss, part in zip(*(c.to_pylist() for c in batch.columns)):
                x = held.setdefault(block, [0, 0.0, 0.0])
                x[0], x[1], x[2] = x[0] + n, x[1] + loss, x[2] + np.frombuffer(part)
        for block, (n, loss, part) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n]), pa.array([loss]), pa.array([part.tobytes()], pa.binary())], ["block", "n", "loss", "part"])

    rows = sorted(examples.mapInArrow(sums, schema).repartition(BLOCKS, "block").mapInArrow(added, schema).collect())  # as many numbers as weights
    shared.destroy()
    return (rows[0].n, rows[0].loss, np.concatenate([np.frombuffer(r.part) for r in rows])) if rows else (0, 0.0, np.zeros(0))


def trained(texts: DataFrame, steps: int = 40, lr: float = 0.03, old: NeuralLM | None = None, seed: int = 0, size: int = VOCABULARY) -> NeuralLM | None:
    """A model of all texts (column text), warm-started from `old`; None if they have fewer than a context and LEAST tokens.

    Null and empty texts have no tokens. A step is one bucket of about
    STEP_TOKENS tokens, and the buckets take turns.
    """
    model = NeuralLM.fresh(vocabulary(texts, size), seed=seed)
    examples = Examples(texts, model)
    if examples.n_tokens < model.context + LEAST:
        return None
    if old is not None:
        model = model.warm_started(old)
    shapes = [w.shape for w in model.weights]
    flat = np.concatenate([w.ravel() for w in model.weights])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    for k in range(1, steps + 1):
        n, loss, grad = total_gradient(examples.bucket(k), model.weights)
        if n:
            mean, square = 0.9 * mean + 0.1 * grad / n, 0.99 * square + 0.01 * (grad / n) ** 2
            flat = flat - lr * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
            model.weights = [x.reshape(s) for x, s in zip(np.split(flat, cuts), shapes)]
            model.losses.append(loss / n)
        model.steps += 1
    return model


def pretrained(spark: SparkSession, path: str, texts: DataFrame, force: bool = False, **options) -> NeuralLM | None:
    """The model saved at `path`; trained and saved first if there is none, or trained further if forced."""
    try:
        old = NeuralLM.load(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None and not force:
        return old
    model = trained(texts, old=old, **options)
    if model is not None:
        model.save(spark, path)
    return model


def sequence_scores(model: NeuralLM, rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, n, log_prob): tokens of each text and the sum of their log probabilities; null and empty texts have none."""
    one_thread(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        lookup = {t: k + 1 for k, t in enumerate(m.tokens)}
        for batch in batches:
            out = np.zeros(batch.num_rows)
            lists = batch.column(batch.num_columns - 1).to_pylist()
            for k, tokens in enumerate(lists):
                ids = np.array([lookup.get(t, 0) for t in tokens], np.int64)
                contexts = windows(ids, m.context)
                for lo in range(0, len(ids), CHUNK):
                    logp = log_probs(m.weights, contexts[lo : lo + CHUNK])[2]
                    out[k] += logp[np.arange(len(logp)), ids[lo : lo + CHUNK]].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in lists], pa.int64()), pa.array(out)], [*keys, "n", "log_prob"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, T.lm_tokens(F.coalesce("text", F.lit(""))).alias("tokens")).mapInArrow(work, f"{schema}, n long, log_prob double")
