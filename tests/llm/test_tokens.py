"""op4, op7 and op8 against the libraries and against brute force."""

import collections
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from lexloom.llm import nbest, pretokens, repair, textkit, token_counts  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
ALPHABET = list("ab  \n\t'strevlmd19.,!é漢 　\u0085\u001c²½٣=-<|endoftext|>")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(2)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) + r.choice(["", "<|endoftext|>", "'<|endoftext|>ll"]) for _ in range(1500)] + ["-" * 3000, " " * 2000, "a" * 3000, "the" * 1000, "", "'s't're 'x''ll"]


def test_pretokens_begin_where_the_library_begins_them(library, odd_texts):
    offsets, data = textkit.text_buffer(pa.array(odd_texts))
    begins, _ = pretokens.boundaries(offsets, data, b"<|endoftext|>")
    want = set()
    for k, text in enumerate(odd_texts):
        at = int(offsets[k])
        for n, part in enumerate(text.split("<|endoftext|>")):
            if n:
                want.add(at)
                at += 13
            want |= {at + len(part[:u].encode()) for _, (u, _) in library.pre_tokenizer.pre_tokenize_str(part)}
            at += len(part.encode())
    assert set(begins.tolist()) == want


def test_chunk_maps_compose_whatever_the_chunk():
    symbols = np.random.default_rng(1).integers(0, 32, 5000).astype(np.uint8)
    whole = pretokens.run(symbols, 5000)
    for chunk in (1, 3, 64, 999):
        assert (pretokens.run(symbols, chunk) == whole).all()


def test_counts_equal_the_library(library, odd_texts):
    machine = token_counts.CountMachine(PATH)
    offsets, data = textkit.text_buffer(pa.array(odd_texts))
    want = [len(e.ids) for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    assert machine.count(offsets, data).tolist() == want
    machine.reset()  # states are rebuilt on demand
    assert machine.count(offsets, data).tolist() == want


def test_op7(docs, none, known, library):
    got = sorted(map(tuple, token_counts.token_counts(docs, PATH, 50).collect()))
    n = [len(e.ids) for e in library.encode_batch([t for _, t in known], add_special_tokens=False)]
    assert got == sorted((k, len(t.encode()), m, m > 50) for (k, t), m in zip(known, n))
    assert token_counts.token_counts(none, PATH).count() == 0


def test_files_with_several_added_tokens_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": "<|other|>"})
    (tmp_path / "two.json").write_text(json.dumps(spec), encoding="utf-8")
    for kind in (token_counts.CountMachine, repair.Encoder):
        with pytest.raises(ValueError):
            kind(str(tmp_path / "two.json"))


def test_blocks_round_trip_and_decode_one_document():
    r = np.random.default_rng(3)
    docs = [np.append(r.integers(1, 30, r.integers(0, 400)), 0) for _ in range(40)]
    docs[5] = np.array([7, 7, 7, 7, 7, 7, 7, 0])
    blob = repair.pack(np.arange(40), np.array([len(d) for d in docs]), np.concatenate(docs), 100)
    block = repair.Block(blob)
    assert (block.all() == np.concatenate(docs)).all() and len(block.sequence) < sum(map(len, docs))
    assert all((block.document(k) == d).all() for k, d in enumerate(docs))
    with pytest.raises(ValueError):
        repair.Block(b"something else" * 9)


@pytest.mark.parametrize("rules", [2048, 3])
def test_grammars_end_where_no_pair_is_worth_a_rule(monkeypatch, rules):
    monkeypatch.setattr(repair, "RULES_A_ROUND", rules)
    monkeypatch.setattr(repair, "GAIN", 0)
    r = np.random.default_rng(4)
    passage = r.integers(1, 50, 300)
    ids = np.concatenate([np.concatenate([r.integers(1, 50, r.integers(0, 60)), passage, [0]]) for _ in range(30)] + [np.full(5000, 9), [0], r.integers(1, 4, 800)]).astype(np.uint32)
    seq, left, right, length = repair.compress(ids, 100)
    pairs = collections.Counter((a, b) for a, b in zip(seq[:-1].tolist(), seq[1:].tolist()) if a and b)
    assert max(pairs.values(), default=0) < repair.LEAST
    size = [1] * 100 + length.tolist()
    assert all(size[100 + k] == size[x] + size[y] and max(x, y) < 100 + k for k, (x, y) in enumerate(zip(left.tolist(), right.tolist())))
    assert length.max() > 100 and sum(size[x] for x in seq.tolist()) == len(ids)
    block = repair.Block(repair.pack(np.arange(1), np.array([len(ids)]), ids, 100))
    assert (block.all() == ids).all()


def test_op4(docs, none, known, library):
    got = sorted(map(tuple, repair.token_files(docs, PATH).collect()), key=lambda r: r[1])
    start, want = 0, []
    for k, t in sorted(known):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert repair.token_files(none, PATH).count() == 0


def brute_scores(lattice, text, n):
    t = nbest.MARK + text.replace(" ", nbest.MARK) if text else ""
    best = [[0.0]] + [[] for _ in t]
    for j in range(1, len(t) + 1):
        sums = []
        for i in range(max(0, j - lattice.longest), j):
            piece = lattice.pieces.get(t[i:j])
            if piece:
                sums += [s + piece[1] for s in best[i]]
            elif j == i + 1:
                sums += [s + lattice.unknown for s in best[i]]
        best[j] = sorted(sums, reverse=True)[:n]
    return best[-1]


def test_segmentations_are_the_best_ones():
    lattice = nbest.Lattice(public.path("piece_bpe_32k.model"), 4)
    r = random.Random(5)
    letters = list("ab the in on ing漢é  ..,\n😀﷐▁")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(400)] + ["a" * 200, "", "  x", " " * 40]
    offsets, data = textkit.text_buffer(pa.array(texts))
    for text, (ids, scores, second, same) in zip(texts, lattice.segment(offsets, data)):
        assert np.allclose(scores, brute_scores(lattice, text, 4)) and same == ("▁" not in text)
        if second is not None and "▁" not in text:
            raw, _ = lattice.decode(np.asarray(second), np.array([0, len(second)]))
            assert raw == b" " + text.encode() and list(second) != list(ids)


def test_op8_searches_short_parts_side_by_side(monkeypatch):
    """All searches of a block take a step together, and find what a search by itself finds, in its order."""
    lattice = nbest.Lattice(public.path("piece_bpe_32k.model"), 4)
    r = random.Random(11)
    parts = ["".join(r.choice(letters) for _ in range(r.randint(1, nbest.SHORT))) for letters in ("theinonga", "aab", "é漢😀a▁", "\x00\n1.", "▁") for _ in range(120)]
    parts += ["a" * k for k in range(1, nbest.SHORT + 1)]
    scores, counts, ids = lattice.search(parts)
    ends, at = np.cumsum(counts), 0
    for part, mine in zip(parts, scores):
        want = lattice.paths(part)
        assert mine[: len(want)].tolist() == [s for s, _ in want] and (mine[len(want) :] == -np.inf).all()
        for _, path in want:
            assert ids[ends[at] - counts[at] : ends[at]].tolist() == path
            at += 1
    assert at == len(counts) and ends[-1] == len(ids)

    alone, paths = [], lattice.paths
    monkeypatch.setattr(lattice, "paths", lambda part: alone.append(part) or paths(part))
    texts = ["The quick brown fox, which is by no means lazy, jumps over 13 dogs.", "b" + "a" * 200, ""]
    got = lattice.best_paths(*textkit.text_buffer(pa.array(texts)))
    assert [len(x[0]) for x in got] == [4, 4, 1] and alone and all(len(x) > nbest.SHORT for x in alone)


def test_op8(docs, none, known):
    got = nbest.segmentations(docs, public.path("piece_bpe_32k.model")).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in known)
    assert all(r.round_trip == ("▁" not in dict(known)[r.doc_id]) and r.scores == sorted(r.scores, reverse=True) and r.n_best == len(r.scores) for r in got)
    empty = [r for r in got if r.doc_id in (40, 41)]
    assert [(r.n_pieces, r.scores, r.second_crc32) for r in empty] == [(0, [0.0], None)] * 2
    assert nbest.segmentations(none, public.path("piece_bpe_32k.model")).count() == 0


def test_op8_gives_every_path_and_the_decoded_text(docs, known):
    """All n paths come out, each a segmentation of the text with the score it is given."""
    path = public.path("piece_bpe_32k.model")
    lattice, texts = nbest.Lattice(path, 4), dict(known)
    score = {k: s for k, s in lattice.pieces.values()}
    figures = {(r.doc_id, r.ids_crc32): r for r in nbest.segmentations(docs, path).collect()}
    n = 0
    for r in nbest.best_paths(docs, path).collect():
        assert r.decoded == texts[r.doc_id].replace("▁", " ") and len(r.ids) == len(r.scores) == len(set(map(bytes, r.ids)))
        paths = [np.frombuffer(x, "<i4") for x in r.ids]
        for ids, total in zip(paths, r.scores):
            if len(ids):
                raw, _ = lattice.decode(ids, np.array([0, len(ids)]))
                assert raw == b" " + r.decoded.encode()
            if all(int(k) in score for k in ids):
                assert np.isclose(sum(score[int(k)] for k in ids), total)
                n += 1
        own = figures[r.doc_id, zlib.crc32(r.ids[0])]
        assert own.path_pieces == [len(x) for x in paths] and own.path_crc32 == [zlib.crc32(x) for x in r.ids]
    assert n > 80
