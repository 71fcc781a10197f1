"""op3: Brown class-based bigram language model.

The vocabulary is all training words, and each of them has a class. Seeds are
the KINDS most frequent words, one type for each hashed two-byte word ending
(all other words at first) and the end of a text: exchange clustering moves
them between classes while the class-bigram likelihood of the training corpus
rises. Then each further word goes to the class that its own neighbours make
likeliest: how often each class stands before and after it is counted in all
training texts, in sparse (word, class) counts. Only words that no training
text has take the class of their ending. A text's probability is the product
over its words of (class | class before) and (word | class), both smoothed:

    P(c2 | c1) = (n(c1, c2) + 0.5) / (n(c1) + 0.5 C)
    P(w | c)   = (n(w) + 0.5) / (n(c) + 0.5 (V(c) + 1))

All counts cover all training texts, and class bigrams are counted after the
last word has its class. Type-bigram counts of the seeds have a size fixed by
parameters (TYPES squared), whatever the corpus. Counts and classes of the HEAD
most frequent words are shipped to the tasks (a table of fixed size); those of
all other words are joined by the word's hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit

KINDS, ENDINGS, CLASSES, HEAD = 1024, 512, 64, 1 << 18
TYPES = KINDS + ENDINGS + 1
END = TYPES - 1
SWEEPS = 5
#: Added to the class of a word that is yet to be joined.
UNSURE = 128
FLUSH = 3_000_000


def tokens(offsets: np.ndarray, data: np.ndarray):
    """Hashes, endings and texts of the words of a segment, lower case."""
    data = textkit.lower(data)
    starts, ends, docs = textkit.word_spans(offsets, data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, docs
    hashes = textkit.range_hash(textkit.prefix_hash(data), starts, ends)
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)].astype(np.int64), 0)
    return hashes, (last * 31 + before * 257) % ENDINGS, docs


def is_training(doc_ids, fold: int = 1) -> np.ndarray:
    return np.array([textkit.crc_mod(k, 5) != fold for k in doc_ids], bool)


def training_words(batches, fold: int = 1):
    """(hash, ending, n, texts) summed over a task; the end token's row has hash 0."""
    held: list[tuple] = []
    texts = 0

    def flush():
        h, e, n = (np.concatenate(x) for x in zip(*held))
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        held.clear()
        held.append((u, e[first], np.bincount(inverse, n, len(u)).astype(np.int64)))

    for batch in batches:
        use = is_training(batch.column(0).to_pylist(), fold)
        for lo, hi, offsets, data in textkit.segments(batch.column(1)):
            hashes, endings, docs = tokens(offsets, data)
            inside = use[lo:hi][docs]
            u, first, n = np.unique(hashes[inside], return_index=True, return_counts=True)
            held.append((u, endings[inside][first], n))
            texts += int(use[lo:hi].sum())
            if len(held) > 1 and sum(len(x[0]) for x in held) > FLUSH:
                flush()
                if len(held[0][0]) > FLUSH // 2:
                    u, e, n = held.pop()
                    yield pa.RecordBatch.from_pydict({"word": u.view(np.int64), "ending": e.astype(np.int32), "n": n})
    if held:
        flush()
        u, e, n = held[0]
        yield pa.RecordBatch.from_pydict({"word": u.view(np.int64), "ending": e.astype(np.int32), "n": n})
    if texts:
        yield pa.RecordBatch.from_pydict({"word": pa.array([0], pa.int64()), "ending": pa.array([-1], pa.int32()), "n": pa.array([texts], pa.int64())})


def type_ids(index: textkit.HashIndex, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
    at = index.find(hashes)
    return np.where(at >= 0, at, KINDS + endings)


def with_ends(types: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Types with an end after each text, and the text of each."""
    counts = np.bincount(docs, minlength=n_docs)
    return np.insert(types, np.cumsum(counts), END), np.repeat(np.arange(n_docs), counts + 1)


def type_bigrams(docs: DataFrame, top: np.ndarray, fold: int = 1) -> np.ndarray:
    """Counts of type pairs in training texts; the type before a text is END."""
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def count(batches):
        index = textkit.HashIndex()
        index.put(shared.value, np.arange(len(shared.value)))
        total, codes = None, []

        def add():
            nonlocal total
            n = np.bincount(np.concatenate(codes), minlength=TYPES * TYPES).astype(np.int64)
            total = n if total is None else total + n
            codes.clear()

        for batch in batches:
            use = is_training(batch.column(0).to_pylist(), fold)
            for lo, hi, offsets, data in textkit.segments(batch.column(1)):
                hashes, endings, at = tokens(offsets, data)
                types, at = with_ends(type_ids(index, hashes, endings), at, hi - lo)
                before = np.concatenate(([END], types[:-1]))
                inside = use[lo:hi][at]
                codes.append((before * TYPES + types)[inside])
                if sum(map(len, codes)) > FLUSH:
                    add()
        if codes:
            add()
        if total is not None:
            rows = total.reshape(TYPES, TYPES)
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_pydict({"before": pa.array(some, pa.int32()), "counts": pa.array([rows[k].astype("<u4").tobytes() for k in some], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.frombuffer(blob, f"<u{len(blob) // TYPES}").astype("<u8")
                sums[k] = sums[k] + n if k in sums else n
        if sums:
            yield pa.RecordBatch.from_pydict({"before": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "before int, counts binary"
    merged = docs.mapInArrow(count, schema).repartition("before").mapInArrow(merge, schema)
    out = np.zeros((TYPES, TYPES))
    for k, blob in merged.collect():  # at most TYPES rows of TYPES counts
        out[k] += np.frombuffer(blob, "<u8")
    return out


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering: the class of each type. The last type keeps a class of its own (the last).

    The most frequent types begin one class each; the first sweep inserts the
    others, most frequent first, into the class that fits best; later sweeps
    take each type out of its class and put it where the class-bigram
    likelihood is highest.
    """
    n = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1))[: n - 1], kind="stable")
    member = np.full(n, -1, np.int64)
    member[order[: classes - 1]] = np.arange(min(classes - 1, n - 1))
    member[n - 1] = classes - 1
    hot = np.zeros((n, classes))
    some = np.flatnonzero(member >= 0)
    hot[some, member[some]] = 1
    right, left = pairs @ hot, pairs.T @ hot  # of each type: counts of the classes after and before it
    table = hot.T @ right
    f = lambda x: x * np.log(np.maximum(x, 1))
    for sweep in range(sweeps + 1):
        moved = 0
        for w in order:
            own, old = pairs[w, w], member[w]
            if sweep == 0 and old >= 0:
                continue
            out, into = right[w].copy(), left[w].copy()
            if old >= 0:  # take w out of its class
                out[old] -= own
                into[old] -= own
                table[old, :] -= out
                table[:, old] -= into
                table[old, old] -= own
            rows, cols = table.sum(1) + into, table.sum(0) + out  # with w in no class yet, but counted beside the others
            gain = (f(table + out) - f(table)).sum(1) + (f(table + into[:, None]) - f(table)).sum(0)
            diag = np.diagonal(table)
            gain += f(diag + out + into + own) - f(diag + out) - f(diag + into) + f(diag)
            gain -= f(rows + out.sum() + own) - f(rows) + f(cols + into.sum() + own) - f(cols)
            gain[classes - 1] = -np.inf
            new = int(np.argmax(gain))
            if old >= 0 and gain[new] <= gain[old] + 1e-9:
                new = old
            table[new, :] += out
            table[:, new] += into
            table[new, new] += own
            if new != old:
                moved += 1
                member[w] = new
                right[:, new] += pairs[:, w]
                left[:, new] += pairs[w, :]
                if old >= 0:
                    right[:, old] -= pairs[:, w]
                    left[:, old] -= pairs[w, :]
        if sweep and not moved:
            break
    return member


def context_counts(docs: DataFrame, top: np.ndarray, member: np.ndarray, fold: int = 1) -> DataFrame:
    """(word, cell) of training words beyond the seeds: cell is 2 * CLASSES * count + context, and the context a class before, or CLASSES + a class after."""
    shared = docs.sparkSession.sparkContext.broadcast((top, member))

    def count(batches):
        top, member = shared.value
        index = textkit.HashIndex()
        index.put(top, np.arange(len(top)))
        held = []

        def summed():
            w, c, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            u, at = np.unique(w, return_inverse=True)
            cells, at = np.unique(at * (2 * CLASSES) + c, return_inverse=True)
            held.append((u[cells // (2 * CLASSES)], cells % (2 * CLASSES), np.bincount(at, n).astype(np.int64)))

        def row():
            w, c, n = held.pop()
            return pa.RecordBatch.from_pydict({"word": w.view(np.int64), "cell": n * (2 * CLASSES) + c})

        for batch in batches:
            use = is_training(batch.column(0).to_pylist(), fold)
            for lo, hi, offsets, data in textkit.segments(batch.column(1)):
                hashes, endings, at = tokens(offsets, data)
                ends = np.cumsum(np.bincount(at, minlength=hi - lo))
                types, where = with_ends(type_ids(index, hashes, endings), at, hi - lo)
                classes = member[types]
                rest = np.flatnonzero((types >= KINDS) & (types != END) & use[lo:hi][where])
                if not len(rest):
                    continue
                words = np.insert(hashes, ends, 0)[rest]
                before = np.concatenate(([CLASSES - 1], classes[:-1]))[rest]
                held.append((np.tile(words, 2), np.concatenate((before, CLASSES + classes[rest + 1])), np.ones(2 * len(rest))))
                if sum(len(x[0]) for x in held) > FLUSH // 2:
                    summed()
                    if len(held[0][0]) > FLUSH // 4:
                        yield row()
        if held:
            summed()
            yield row()

    return docs.mapInArrow(count, "word long, cell long")


def best_classes(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, class, n): the class where a word's neighbours raise the likelihood of the class bigrams most."""
    logs = np.log(table + 0.5)
    gain = np.concatenate((logs - np.log(table.sum(0) + 0.5 * CLASSES), (logs - np.log(table.sum(1) + 0.5 * CLASSES)[:, None]).T))
    gain[:, CLASSES - 1] = -1e9  # of the end alone
    shared = contexts.sparkSession.sparkContext.broadcast(gain)

    def best(words, cells):
        first = np.ones(len(words), bool)
        first[1:] = words[1:] != words[:-1]
        m = int(first.sum())
        counts = np.bincount((np.cumsum(first) - 1) * (2 * CLASSES) + cells % (2 * CLASSES), cells // (2 * CLASSES), m * 2 * CLASSES).reshape(m, -1)
        found = np.argmax(np.round(counts @ shared.value, 6), 1)
        return pa.RecordBatch.from_pydict({"word": words[first], "class": found.astype(np.int32), "n": counts[:, :CLASSES].sum(1).astype(np.int64)})

    def choose(batches):
        words = cells = np.zeros(0, np.int64)
        for batch in batches:
            words = np.concatenate((words, batch.column(0).to_numpy()))
            cells = np.concatenate((cells, batch.column(1).to_numpy()))
            cut = int(np.searchsorted(words, words[-1])) if len(words) else 0  # the last word may go on
            if cut:
                yield best(words[:cut], cells[:cut])
                words, cells = words[cut:], cells[cut:]
        if len(words):
            yield best(words, cells)

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word long, class int, n long")


def blobs(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.astype(np.uint8).tobytes())])


def class_runs(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words of all texts of a batch, and the text of each."""
    column = batch.column(name)
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.astype(np.int64), np.repeat(np.arange(len(batch)), np.diff(offsets))


def resolve(batches):
    """Classes and counts of joined words put into their places; only unseen words keep the class of their ending."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        codes, at = class_runs(batch, "codes")
        rare = batch.column("n_rare").to_numpy()
        base = np.concatenate(([0], np.cumsum(rare)))
        classes, counts = np.full(base[-1], -1), np.zeros(base[-1], np.int64)
        found = batch.column("found")
        cells = found.flatten()
        if len(cells):
            of = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
            place = base[of] + cells.field("j").to_numpy()
            classes[place], counts[place] = cells.field("class").to_numpy(), cells.field("n").to_numpy()
        open_ = np.flatnonzero(codes >= UNSURE)
        place = base[at[open_]] + batch.column("which").flatten().to_numpy()
        codes[open_] = np.where(classes[place] >= 0, classes[place], codes[open_] - UNSURE)
        logs = np.bincount(at[open_], np.log10(counts[place] + 0.5), n)
        more = np.bincount(at[open_], counts[place] > 0, n).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=n))))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": batch.column("n_tokens"),
                "n_known": batch.column("n_known").to_numpy() + more, "logs": batch.column("logs").to_numpy() + logs, "classes": blobs(offsets, codes),
            }
        )


def class_bigrams(texts: DataFrame, fold: int = 1) -> np.ndarray:
    """Counts of class pairs in training texts; the class before a text is the end's."""

    def count(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            codes, at = class_runs(batch, "classes")
            use = is_training(batch.column("doc_id").to_pylist(), fold)
            before = np.concatenate(([CLASSES - 1], codes[:-1]))
            total += np.bincount((before * CLASSES + codes)[use[at]], minlength=CLASSES * CLASSES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": some.astype(np.int32), "n": total[some]})

    out = np.zeros(CLASSES * CLASSES)
    rows = texts.select("doc_id", "classes").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # CLASSES squared at most
    out[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out.reshape(CLASSES, CLASSES)


def class_model_scores(docs: DataFrame, fold: int = 1) -> DataFrame:
    """Score every text with a model learnt from the texts whose crc32(doc_id) mod 5 is not `fold`.

    One row for each row with a doc_id (rows without one are left out,
    repeated rows give one row each). Null and empty texts consist of the end
    token. Without any training text, counts are 0 and the smoothed formulas
    still hold. Other columns are ignored.
    """
    spark = docs.sparkSession
    textkit.on_workers(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    counted = textkit.saved(docs.mapInArrow(lambda batches: training_words(batches, fold), "word long, ending int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")))
    words = counted.where("ending >= 0")
    # the least count at which at most HEAD words are frequent: from a table of counts, not of words
    by_count = words.groupBy("n").agg(F.count("*").alias("m")).select("n", F.sum("m").over(Window.orderBy(F.desc("n"))).alias("upto"))
    least = by_count.where(F.col("upto") <= HEAD).agg(F.min("n")).first()[0] or 0
    head = words.where(F.col("n") >= least).toPandas() if least else words.limit(0).toPandas()  # HEAD rows at most
    head = head.sort_values(["n", "word"], ascending=[False, True])
    head_hash, head_n = head["word"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    texts = counted.where("ending < 0").agg(F.sum("n")).first()[0] or 0
    tops = min(KINDS, len(head_hash))
    pairs = type_bigrams(docs, head_hash[:tops], fold)
    member = exchange(pairs)
    hot = np.eye(CLASSES)[member]
    assigned = textkit.saved(best_classes(context_counts(docs, head_hash[:tops], member, fold), hot.T @ pairs @ hot))
    # of each class: training tokens and words
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, n, v in assigned.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas().itertuples(index=False):  # CLASSES rows
        class_n[c], class_v[c] = n, v
    np.add.at(class_n, member[:tops], head_n[:tops])
    np.add.at(class_v, member[:tops], 1)
    class_n[CLASSES - 1], class_v[CLASSES - 1] = texts, texts > 0
    total, distinct = int(class_n.sum()), int(class_v.sum())
    head_class = np.full(len(head_hash), -1)
    head_class[:tops] = member[:tops]
    if len(head_hash) > tops:
        index = textkit.HashIndex()
        index.put(head_hash, np.arange(len(head_hash)))
        more = assigned.where(F.col("n") >= least).select("word", "class").toPandas()  # HEAD rows at most
        head_class[index.find(more["word"].to_numpy(np.int64).view(np.uint64))] = more["class"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((head_hash, head_n, head_class, member, texts))

    def encode(batches):
        head_hash, head_n, head_class, member, ends = shared.value
        index = textkit.HashIndex(1 << 20)
        index.put(head_hash, np.arange(len(head_hash)))
        logs = np.log10(np.append(head_n, 0) + 0.5)
        end_log = np.log10(ends + 0.5)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, offsets, data in textkit.segments(batch.column(1)):
                n = hi - lo
                hashes, endings, at = tokens(offsets, data)
                place = index.find(hashes)
                rest = place < 0
                codes = np.where(rest, UNSURE + member[KINDS + endings], np.append(head_class, 0)[place])
                size = np.bincount(at, minlength=n)
                codes = np.insert(codes, np.cumsum(size), CLASSES - 1)
                seen = np.bincount(at, np.where(rest, 0.0, logs[place]), n) + end_log
                n_known = np.bincount(at, ~rest, n).astype(np.int64) + (ends > 0)
                rare, rare_at = hashes[rest], at[rest]
                order = np.lexsort((rare, rare_at))
                words, words_at = rare[order], rare_at[order]
                first = np.ones(len(words), bool)
                first[1:] = (np.diff(words_at) != 0) | (words[1:] != words[:-1])
                cut = np.concatenate(([0], np.cumsum(np.bincount(words_at[first], minlength=n))))
                which = np.zeros(len(rare), np.int64)
                which[order] = np.cumsum(first) - 1
                runs = np.concatenate(([0], np.cumsum(np.bincount(rare_at, minlength=n)))).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": np.array(ids[lo:hi], np.int64), "held_out": ~is_training(ids[lo:hi], fold), "n_tokens": size.astype(np.int64) + 1, "n_known": n_known, "logs": seen,
                        "codes": blobs(np.concatenate(([0], np.cumsum(size + 1))), codes), "n_rare": np.diff(cut).astype(np.int32),
                        "which": pa.ListArray.from_arrays(pa.array(runs), pa.array((which - cut[rare_at]).astype(np.int32))), "rare": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(words[first].view(np.int64))),
                    }
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, codes binary, n_rare int, which array<int>, rare array<long>"
    encoded = textkit.saved(docs.mapInArrow(encode, schema).withColumn("key", F.monotonically_increasing_id()))
    tail = assigned.where(F.col("n") < least) if least else assigned
    found = encoded.select("key", F.posexplode("rare").alias("j", "word")).join(tail, "word").groupBy("key").agg(F.collect_list(F.struct("j", "class", "n")).alias("found"))
    known = textkit.saved(encoded.drop("rare").join(found, "key", "left").mapInArrow(resolve, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, classes binary"))
    table = class_bigrams(known, fold)
    step = np.log10((table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * CLASSES)) - np.log10(class_n + 0.5 * (class_v + 1))
    base = np.log10(total + 0.5 * (distinct + 1))

    def score(batches):
        for batch in batches:
            if not len(batch):
                continue
            codes, at = class_runs(batch, "classes")
            before = np.concatenate(([CLASSES - 1], codes[:-1]))
            logs, size = batch.column("logs").to_numpy(), batch.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": batch.column("n_tokens"), "n_known": batch.column("n_known"), "train_tokens": np.full(len(batch), total, np.int64),
                    "base_score": logs - size * base, "score": logs + np.bincount(at, step[before, codes], len(batch)),
                }
            )

    return known.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_class_lm(spark, sf_dir: str) -> DataFrame:
    return class_model_scores(textkit.documents(spark, sf_dir))
