"""op8: N-best segmentation over a SentencePiece vocabulary, and decoding.

A text is normalised as the model does (a leading space mark, marks for
spaces), and its segmentations into pieces are the paths of a lattice; a
path's score is the sum of its pieces' scores. Forward Viterbi gives the best
score from the beginning to each place; used as heuristic it is exact, so a
backward A-star search from the end meets complete paths in the order of
their scores, best first. Characters that are no piece go to byte pieces, at
the score of the worst piece less 10.

A border inside which no piece of the vocabulary reaches across cuts the
lattice into independent ones. Each distinct part is searched once and its
best paths kept in a bounded memo; parts of SHORT characters at most are
searched BLOCK at a time, a step of all their searches in one array operation.
The best paths of a text are the best sums of one path for each part, of which
only those with the smallest losses can matter. Of texts of equal score, the one that departs from the best path at
the earliest part comes first, at every length of text.
"""

from __future__ import annotations

import bisect
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

MARK = "▁"
#: Parts in the memo, some 170 bytes each; it is dropped when full. Workers keep it beyond their tasks, so it is small.
MEMO = 150_000
#: Characters of the parts that are searched side by side, and how many of them; longer ones are searched one by one.
SHORT, BLOCK = 48, 2048
#: Bytes of text at a time: the lattice's arrays take some forty times as much.
PIECE = 1 << 18
#: Code points below this have a plain table of pairs that pieces hold.
LOW = 1024
SCHEMA = "doc_id long, n_bytes long, scores array<double>, ids array<binary>, decoded string, round_trip boolean"
_lattices: dict[tuple[str, int], "Lattice"] = {}


class Lattice:
    """The pieces of one model, and N-best paths of texts."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size, self.n = model.vocab_size(), n
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        surface = [b""] * size
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                surface[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.pieces[piece] = (k, model.get_score(k))
                surface[k] = piece.replace(MARK, " ").encode()
        scores = [s for _, s in self.pieces.values() if s > -1e8]
        self.unknown = min(scores) - 10.0
        self.longest = max(map(len, self.pieces))
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        state = {p: k for k, p in enumerate(sorted(self.prefixes), 1)}  # 0: nothing read
        self.after = textkit.HashIndex(1 << (2 * len(state)).bit_length())  # by state and next character
        self.after.put(self.step(np.array([state.get(p[:-1], 0) for p in state]), np.array([ord(p[-1]) for p in state])), np.array(list(state.values())))
        self.state_piece, self.state_score = np.full(len(state) + 1, -1), np.zeros(len(state) + 1)
        for p, (k, score) in self.pieces.items():
            self.state_piece[state[p]], self.state_score[state[p]] = k, score
        inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.joint_low = np.zeros((LOW, LOW), bool)
        for x in inside:
            if max(map(ord, x)) < LOW:
                self.joint_low[ord(x[0]), ord(x[1])] = True
        self.joint = np.sort(np.array([ord(x[0]) << 21 | ord(x[1]) for x in inside], np.int64))
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.reset()

    def reset(self) -> None:
        # of full size at once: pages are taken as they are filled, and nothing is copied to grow
        rows = MEMO + (MEMO >> 2)
        self.index = textkit.HashIndex(1 << (2 * rows - 1).bit_length())
        self.known = self.filled = 0
        self.ids = np.zeros(24 * rows, np.int32)
        self.start, self.size = np.zeros(rows, np.int32), np.zeros(rows, np.int32)
        self.best = np.zeros(rows)
        self.loss = np.zeros((rows, self.n - 1))  # of the second path, the third ...
        self.other_start, self.other_size = np.zeros((rows, self.n - 1), np.int32), np.zeros((rows, self.n - 1), np.int32)

    def paths(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a normalised part: (score, piece ids); equal scores in a fixed order."""
        m = len(text)
        edges: list[list[tuple[int, float, object]]] = [[] for _ in range(m + 1)]
        ahead = [float("-inf")] * (m + 1)
        ahead[0] = 0.0
        pieces, prefixes = self.pieces, self.prefixes
        for i in range(m):
            base, single = ahead[i], False
            for j in range(i + 1, min(m, i + self.longest) + 1):
                piece = text[i:j]
                if piece not in prefixes:
                    break
                hit = pieces.get(piece)
                if hit:
                    single = single or j == i + 1
                    edges[j].append((i, hit[1], hit[0]))
                    if base + hit[1] > ahead[j]:
                        ahead[j] = base + hit[1]
            if not single:
                edges[i + 1].append((i, self.unknown, text[i]))
                if base + self.unknown > ahead[i + 1]:
                    ahead[i + 1] = base + self.unknown
        found: list[tuple[float, list[int]]] = []
        tick = itertools.count()
        heap = [(-ahead[m], m, next(tick), 0.0, None)]
        while heap and len(found) < self.n:
            f, at, _, done, chain = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while chain is not None:
                    piece, chain = chain
                    ids.extend([piece] if isinstance(piece, int) else [self.byte[b] for b in piece.encode()])
                found.append((-f, ids))
                continue
            for i, score, piece in edges[at]:
                heapq.heappush(heap, (-(ahead[i] + score + done), i, next(tick), score + done, (piece, chain)))
        return found

    @staticmethod
    def step(state: np.ndarray, point: np.ndarray) -> np.ndarray:
        return ((state + 1) << 21 | point).astype(np.uint64)

    def edges(self, points: np.ndarray, sizes: np.ndarray):
        """Edges of the lattices of some parts, a row of points each, by end, part and begin: (part, begin, end, score, piece or -1 for a character that is none)."""
        part, begin = np.nonzero(np.arange(points.shape[1]) < sizes[:, None])
        single, state, end, found = np.zeros(points.shape, bool), np.zeros(len(part), np.int64), begin, []
        whole = part, begin
        while len(part):
            state = self.after.find(self.step(state, points[part, end]))
            on = np.flatnonzero(state > 0)
            part, begin, state, end = part[on], begin[on], state[on], end[on] + 1
            hit = self.state_piece[state] >= 0
            found.append((part[hit], begin[hit], end[hit], self.state_score[state[hit]], self.state_piece[state[hit]]))
            if len(found) == 1:
                single[part[hit], begin[hit]] = True
            on = np.flatnonzero(end < sizes[part])
            part, begin, state, end = part[on], begin[on], state[on], end[on]
        none = ~single[whole]
        part, begin = whole[0][none], whole[1][none]
        found.append((part, begin, begin + 1, np.full(len(part), self.unknown), np.full(len(part), -1)))
        part, begin, end, score, piece = map(np.concatenate, zip(*found))
        order = np.argsort((end * len(points) + part) * (points.shape[1] + 1) + begin)
        return part[order], begin[order], end[order], score[order], piece[order]

    def search(self, parts: list[str]):
        """What paths finds, for many short parts at once: scores (-inf: none), numbers of ids, and all ids; by part, then best first."""
        n, sizes = len(parts), np.array([len(x) for x in parts])
        points = np.zeros((n, sizes.max()), np.int64)
        points[np.arange(points.shape[1]) < sizes[:, None]] = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        part, begin, end, gain, piece = self.edges(points, sizes)
        source = begin * n + part  # places are numbered by character, then part
        first = np.concatenate(([0], np.cumsum(np.bincount(end * n + part, minlength=(points.shape[1] + 1) * n))))
        ahead = np.zeros((points.shape[1] + 1) * n)
        for j in range(1, points.shape[1] + 1):
            a, b = first[j * n], first[(j + 1) * n]
            starts = first[j * n : (j + 1) * n]
            some = np.flatnonzero(first[j * n + 1 : (j + 1) * n + 1] > starts)
            ahead[j * n + some] = np.maximum.reduceat(ahead[source[a:b]] + gain[a:b], starts[some] - a)
        # column k of a row: the k-th place pushed by that part's search
        cost, place, done = np.full((n, 32), np.inf), np.zeros((n, 32), np.int32), np.zeros((n, 32))
        chain, edge = np.zeros((n, 32), np.int32), np.full((n, 32), -1, np.int32)
        cost[:, 0], place[:, 0] = -ahead[sizes * n + np.arange(n)], sizes
        pushed, count = np.ones(n, np.int64), np.zeros(n, np.int64)
        scores, goal = np.full((n, self.n), -np.inf), np.zeros((n, self.n), np.int64)
        rows = np.arange(n)
        while len(rows):
            open_ = cost[rows, : pushed[rows].max()]
            least = open_.min(1)
            column = np.where(open_ == least[:, None], place[rows, : open_.shape[1]], SHORT + 1).argmin(1)
            rows, column, least = (x[least < np.inf] for x in (rows, column, least))
            cost[rows, column] = np.inf
            at = place[rows, column]
            over = at == 0
            ended = rows[over]
            scores[ended, count[ended]], goal[ended, count[ended]] = -least[over], column[over]
            count[ended] += 1
            grown, column, at = rows[~over], column[~over], at[~over]
            lo = first[at * n + grown]
            more = first[at * n + grown + 1] - lo
            row, back = np.repeat(grown, more), np.repeat(column, more)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
            e, new = np.repeat(lo, more) + nth, np.repeat(pushed[grown], more) + nth
            pushed[grown] += more
            while (width := cost.shape[1]) < pushed.max():
                cost, place, done, chain, edge = (np.concatenate([x, np.full((n, width), x.dtype.type(np.inf if x is cost else 0))], 1) for x in (cost, place, done, chain, edge))
            so_far = done[row, back]
            cost[row, new], place[row, new], done[row, new] = -(ahead[source[e]] + gain[e] + so_far), begin[e], gain[e] + so_far
            chain[row, new], edge[row, new] = back, e
            rows = rows[count[rows] < self.n]
        row, rank = np.nonzero(scores > -np.inf)
        column, path, taken = goal[row, rank], np.arange(len(row)), []
        while len(path):
            e = edge[row, column]
            on = np.flatnonzero(e >= 0)
            row, path = row[on], path[on]
            taken.append((path, e[on]))
            column = chain[row, column[on]]
        path, e = map(np.concatenate, zip(*taken))
        order = np.argsort(path, kind="stable")
        path, e = path[order], e[order]
        size, ids = np.ones(len(e), np.int64), piece[e]
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters that are no piece: their bytes
            raw = [chr(x).encode() for x in points[part[e[odd]], begin[e[odd]]].tolist()]
            size[odd] = [len(x) for x in raw]
            ids = np.repeat(ids, size)
            ids[ids < 0] = np.array(self.byte)[np.frombuffer(b"".join(raw), np.uint8)]
        return scores, np.bincount(path, size, minlength=int(count.sum())).astype(np.int64), ids

    def learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        k, end = self.known, self.known + len(parts)
        while end > len(self.start):
            self.start, self.size, self.best = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.best))
            self.loss = np.concatenate([self.loss, np.zeros_like(self.loss)])
            self.other_start, self.other_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.other_start, self.other_size))
        order = sorted(range(len(parts)), key=lambda x: len(parts[x]))
        short = bisect.bisect_right(order, SHORT, key=lambda x: len(parts[x]))
        for x in range(0, short, BLOCK):
            some = order[x : min(x + BLOCK, short)]
            self.keep(k + np.array(some), *self.search([parts[x] for x in some]))
        for x in order[short:]:
            found = self.paths(parts[x])
            scores = np.full((1, self.n), -np.inf)
            scores[0, : len(found)] = [score for score, _ in found]
            self.keep(np.array([k + x]), scores, np.array([len(ids) for _, ids in found]), np.array([y for _, ids in found for y in ids]))
        self.known = end
        self.index.put(hashes, np.arange(k, end))

    def keep(self, rows: np.ndarray, scores: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Put what was found for some parts into the memo."""
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        size, there = np.zeros(scores.shape, np.int64), scores > -np.inf
        size[there] = counts
        start = self.filled + np.cumsum(size).reshape(size.shape) - size
        self.filled += len(ids)
        self.best[rows], self.start[rows], self.size[rows] = scores[:, 0], start[:, 0], size[:, 0]
        self.loss[rows], self.other_start[rows], self.other_size[rows] = scores[:, :1] - scores[:, 1:], start[:, 1:], size[:, 1:]

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points of normalised text and where independent parts begin (text borders aside)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        a, b = points[:-1], points[1:]
        low = points < LOW
        low = low[:-1] & low[1:]
        joint = self.joint_low[np.where(low, a, 0), np.where(low, b, 0)]
        high = np.flatnonzero(~low)
        pair = a[high] << 21 | b[high]
        joint[high] = self.joint[np.searchsorted(self.joint, pair).clip(max=len(self.joint) - 1)] == pair
        return points, np.flatnonzero(~joint) + 1

    def segment(self, offsets: np.ndarray, data: np.ndarray):
        """For each text: (ids, scores, ids of the second path or None, round trip); texts are a segment's."""
        return [(found[0], scores, found[1] if len(found) > 1 else None, same) for found, scores, _, same in self.best_paths(offsets, data)]

    def best_paths(self, offsets: np.ndarray, data: np.ndarray):
        """For each text: (ids of each of the best paths, their scores, the text that the best one decodes to, round trip); texts are a segment's."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        norm = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(norm)
        sizes = np.array([len(t) for t in norm])
        ends = np.cumsum(sizes)
        if not whole:
            return [([np.zeros(0, np.int32)], [0.0], "", True) for _ in texts]
        if self.known > MEMO or self.filled > 20 * MEMO:
            self.reset()
        points, cuts = self.split(whole)
        begins = np.unique(np.concatenate(([0], cuts, ends[ends < len(points)])))
        stops = np.append(begins[1:], len(points))
        p, q = textkit.powers(len(points) + 1)
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textkit.mix(points.astype(np.uint64) + np.uint64(1)) * p[: len(points)], dtype=np.uint64)))
        hashes = textkit.mix((running[stops] - running[begins]) * q[begins] + (stops - begins).astype(np.uint64))
        at = self.index.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            distinct, where = np.unique(hashes[new], return_index=True)
            where = new[where]
            self.learn(distinct, [whole[a:b] for a, b in zip(begins[where].tolist(), stops[where].tolist())])
            at[new] = self.index.find(hashes[new])
        size = self.size[at].astype(np.int64)
        ids = textkit.gather(self.ids, self.start[at].astype(np.int64), size)
        first = np.searchsorted(begins, np.concatenate(([0], ends)))
        total = np.concatenate(([0], np.cumsum(size)))
        score = np.concatenate(([0.0], np.cumsum(self.best[at])))
        decoded, lengths = self.decode(ids, total[first])
        out, place = [], 0
        for k, text in enumerate(texts):
            a, b = int(first[k]), int(first[k + 1])
            mine = ids[total[a] : total[b]]
            base = float(self.best[at[a:b]].sum())
            combos = self.sums(at[a:b])
            found = [mine]
            for _, way in combos[1:]:
                pieces, done = [], total[a]
                for x, r in way:
                    s = self.other_start[at[a + x], r - 1]
                    pieces += [ids[done : total[a + x]], self.ids[s : s + self.other_size[at[a + x], r - 1]]]
                    done = total[a + x + 1]
                found.append(np.concatenate([*pieces, ids[done : total[b]]]))
            plain = decoded[place : place + lengths[k]]
            same = plain == (b" " + text.encode() if text else b"")
            place += lengths[k]
            out.append((found, [base - loss for loss, _ in combos], text if same else plain[1:].decode("utf-8"), same))
        return out

    def sums(self, parts: np.ndarray) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """The n smallest total losses of a text: (loss, ((part, which of its paths), ...)); equal losses by place in the text, then by path."""
        if not len(parts):
            return [(0.0, ())]
        loss = self.loss[parts]
        second = loss[:, 0]
        if len(parts) > self.n:  # parts whose second path can matter: of equal losses the earliest, as the sort leaves them
            near = np.flatnonzero(second <= np.partition(second, self.n - 2)[self.n - 2])
            few = near[np.argsort(second[near], kind="stable")[: self.n - 1]]
        else:
            few = np.argsort(second, kind="stable")[: self.n - 1]
        few = few[np.isfinite(second[few])]
        ways = [(0.0, ())]
        for x in np.sort(few).tolist():
            ways = heapq.nsmallest(self.n, [(w + d, m + ((x, r),) if r else m) for w, m in ways for r, d in enumerate([0.0, *loss[x].tolist()]) if d < np.inf])
        return ways

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[bytes, list[int]]:
        """Surface bytes of ids (a text begins with the blank that its mark stands for) and the bytes of each text."""
        n = self.surface_size[ids]
        total = np.concatenate(([0], np.cumsum(n)))
        return textkit.gather(self.surface, self.surface_start[ids], n).tobytes(), np.diff(total[cuts]).tolist()


def lattice(path: str, n: int) -> Lattice:
    if (path, n) not in _lattices:
        _lattices[path, n] = Lattice(path, n)
    return _lattices[path, n]


def best_paths(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """The n best segmentations of each text: doc_id, n_bytes, scores, ids, decoded and whether that is the text.

    ids holds the piece ids of each path found, best first, as little-endian
    32-bit integers; decoded is the text that they give back, the same for all
    paths. One row for each row with a doc_id; rows without one are left out,
    repeated rows give one row each. Null and empty texts have one path without
    pieces, of score 0. A text that holds the space mark itself decodes to
    blanks there, so its round_trip is false. Other columns are ignored. The
    stage is a map over partitions, without a shuffle.
    """
    textkit.on_workers(docs.sparkSession)

    def work(batches):
        finder = lattice(model, n)
        for batch in batches:
            for lo, hi, offsets, data in textkit.segments(batch.column(1), PIECE):
                got = finder.best_paths(offsets, data)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array([x[1] for x in got], pa.list_(pa.float64())),
                        pa.array([[ids.astype("<i4", copy=False).tobytes() for ids in x[0]] for x in got], pa.list_(pa.binary())), pa.array([x[2] for x in got], pa.string()), pa.array([x[3] for x in got], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "scores", "ids", "decoded", "round_trip"],
                )

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(work, SCHEMA)


def segmentations(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """What best_paths finds, in figures: doc_id, n_bytes, n_pieces and crc32 of the best path's ids, the scores found, crc32 of the second's ids (null without one), whether decoding gives the text back, and n_pieces and crc32 of each path."""
    own = [F.transform("ids", lambda x: (F.octet_length(x) / 4).cast("long")).alias("path_pieces"), F.transform("ids", lambda x: F.crc32(x)).alias("path_crc32")]
    rows = best_paths(docs, model, n).select("doc_id", "n_bytes", "scores", "round_trip", *own)
    at = lambda c, k: F.get(c, F.lit(k))
    return rows.select("doc_id", "n_bytes", at("path_pieces", 0).alias("n_pieces"), F.size("scores").alias("n_best"), "scores", at("path_crc32", 0).alias("ids_crc32"), at("path_crc32", 1).alias("second_crc32"), "round_trip", "path_pieces", "path_crc32")


def op8_nbest_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segmentations(textkit.documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
