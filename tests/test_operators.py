"""Operators on worked examples and by their invariants."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.functions import vectors as V
from lexloom.operators import agent, calc, chunk, corpus, embed, evaluate, feedback, index, lm, memory, rerank, retrieve
from lexloom.sources import files
from lexloom.streaming import feedback as streaming

DOCS = ["gear transmits power", "bearing supports shaft shaft", "gear and bearing", "weather is sunny"]
# fixed values: a labelled corpus and its questions
CORPUS = [
    "RAG（検索拡張生成）は外部知識を検索してプロンプトに注入し、回答の事実性を高める手法です。", "Reranking reorders retrieved chunks. MMR balances relevance against diversity to reduce redundancy.", "Vector embeddings map text into a numeric space where similar meanings have similar vectors.",
    "Cosine similarity measures the angle between two embedding vectors; 1 means identical direction.", "Photosynthesis lets plants convert sunlight, water and carbon dioxide into glucose and oxygen.", "光合成では植物が太陽光と水と二酸化炭素から糖と酸素を作り出します。",
    "The mitochondria is the organelle that produces ATP, the energy currency of the cell.", "A transformer model uses self-attention to weigh the importance of tokens in a sequence.", "Gradient descent iteratively updates model weights to minimize a loss function.", "Tokenization splits raw text into smaller units called tokens before a model can process it.",
]
QUESTIONS = [("How does reranking with MMR work in retrieval augmented generation?", [0, 1]), ("What are vector embeddings and how is cosine similarity used?", [2, 3]), ("光合成とは何ですか", [4, 5]), ("How do transformer models train with gradient descent?", [7, 8]), ("tokenization of text into tokens", [9])]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query string")


@pytest.fixture(scope="module")
def small(spark):
    return index.CorpusIndex.build(table(spark, DOCS))


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_bm25(spark, small):
    assert scores(retrieve.bm25_scores(small, asks(spark, "gear bearing gear"))) == pytest.approx({0: 0.718001, 1: 0.627938, 2: 1.436002}, abs=1e-6)
    assert scores(retrieve.bm25_scores(small, asks(spark, "shaft"))) == pytest.approx({1: 1.601191}, abs=1e-6)
    boosts = spark.createDataFrame([("gear", 1.5)], "term string, boost double")
    assert scores(retrieve.bm25_scores(small, asks(spark, "gear bearing"), boosts)) == pytest.approx({0: 1.077002, 1: 0.627938, 2: 1.795003}, abs=1e-6)
    same = spark.createDataFrame([("gear", 1.0), ("bearing", 1.0)], "term string, boost double")
    assert scores(retrieve.bm25_scores(small, asks(spark, "gear bearing"), same)) == scores(retrieve.bm25_scores(small, asks(spark, "gear bearing")))


def test_cosine(spark, small):
    assert scores(retrieve.cosine_scores(small, asks(spark, "gear bearing gear"))) == pytest.approx({0: 0.388797, 1: 0.130573, 2: 0.658891}, abs=1e-6)


@pytest.mark.parametrize("k, want", [(1, (1.0, 0.6, 0.75)), (3, (0.533333, 0.9, 0.669767)), (5, (0.32, 0.9, 0.472131))])
def test_labelled_questions(spark, k, want):
    docs, queries = table(spark, CORPUS), asks(spark, *(q for q, _ in QUESTIONS))
    hits = retrieve.zero_filled(retrieve.cosine_scores(index.CorpusIndex.build(docs), queries), queries, docs, k)
    qrels = spark.createDataFrame([(n, d) for n, (_, rel) in enumerate(QUESTIONS) for d in rel], "qid long, doc_id long")
    assert tuple(evaluate.macro_scores(evaluate.precision_recall(hits, qrels, k)).first()) == pytest.approx(want, abs=1e-6)
    if k == 3:
        got = {}
        for r in hits.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.doc_id)
        assert list(got.values()) == [[1, 7, 0], [3, 2, 4], [5, 0, 1], [8, 7, 0], [9, 7, 2]]


def test_pruned_postings(spark):
    docs = table(spark, [f"common word{k % 3} only{k}" for k in range(30)])
    i = index.CorpusIndex.build(docs)
    rows = index.pruned_postings(i, k=4, df_cap=0.4).collect()
    assert {r.term for r in rows} == {"word0", "word1", "word2"} and len(rows) == 12
    assert index.CorpusIndex.build(docs.where("false")).stats.first().avgdl == 1.0


def test_index_round_trips(spark, small, tmp_path):
    small.save(str(tmp_path / "index"), 2)
    again = index.CorpusIndex.load(spark, str(tmp_path / "index"))
    q = asks(spark, "gear bearing")
    assert scores(retrieve.bm25_scores(again, q)) == scores(retrieve.bm25_scores(small, q))
    postings = spark.createDataFrame([("a", 1, 2.5), ("a", 2, 1.0), ("b", 1, 0.25)], "term string, doc_id long, weight double")
    index.write_index_json(postings, spark.createDataFrame([(1, "t")], "doc_id long, title string"), str(tmp_path / "json"))
    assert sorted(map(tuple, index.read_index_json(spark, str(tmp_path / "json")).collect())) == sorted(map(tuple, postings.collect()))


@pytest.mark.parametrize("n, size, overlap, want", [(0, 16, 0, []), (16, 16, 0, [(0, 16, 0)]), (17, 16, 0, [(0, 16, 0), (16, 17, 0)]), (40, 16, 4, [(0, 16, 0), (12, 28, 4), (24, 40, 4)])])
def test_windows(spark, n, size, overlap, want):
    got = chunk.fixed_chunks(table(spark, ["x" * n]), size, overlap).orderBy("chunk_id").collect()
    assert [(r.start, r.end, r.overlap) for r in got] == want


def test_windows_cover_the_text(spark):
    assert chunk.fixed_chunks(table(spark, ["y" * 40]), 4, 99).count() == 25
    assert chunk.fixed_chunks(table(spark, [None, "z" * 1000]), 100, 30).agg(F.max("end")).first()[0] == 1000


def test_packing(spark):
    got = chunk.packed_chunks(table(spark, ["aaaa|bbbb|cccc|dddddd|eeeeeeeeeeeeeeeeeeee|ff"]), "|", 16, 3).orderBy("chunk_id").collect()
    assert [(r.text, r.start, r.end, r.overlap) for r in got] == [("aaaa|bbbb|cccc", 0, 14, 0), ("ccc|dddddd", 12, 22, 0), ("e" * 16, 22, 38, 0), ("e" * 7, 35, 42, 3), ("ff", 43, 45, 0)]


def test_mmr(spark):
    hits = spark.createDataFrame([(0, 10, 0.9, 1), (0, 11, 0.8, 2), (0, 12, 0.5, 3)], "qid long, doc_id long, score double, rank int")
    pairs = spark.createDataFrame([(0, 10, 11, 0.95)], "qid long, a long, b long, cos double")
    order = lambda lam, k=None: [r.doc_id for r in rerank.mmr(hits, pairs, lam, k).orderBy("rank").collect()]
    assert order(1.0) == [10, 11, 12] and order(0.5) == [10, 12, 11] and order(0.5, 2) == [10, 12]


def test_groundedness(spark):
    answers = spark.createDataFrame([(1, "gear moves. zzz qqq gear! 1 2.")], "id long, answer string")
    contexts = spark.createDataFrame([(1, "the gear moves fast")], "id long, context string")
    rows = rerank.groundedness(answers, contexts).orderBy("pos").collect()
    assert [(r.supported, r.total, r.ratio, r.flagged) for r in rows] == [(2, 2, 1.0, False), (1, 3, pytest.approx(1 / 3), True), (0, 0, 1.0, False)]


def test_context(spark):
    hits = spark.createDataFrame([(0, 2, " b "), (0, 1, "a")], "qid long, rank int, text string")
    assert rerank.build_context(hits).first().context == "[1] a\n\n[2] b"
    got = spark.createDataFrame([("ctx $1", "q?")], "c string, q string").select(rerank.fill_template(F.col("c"), F.col("q"), "<{context}|{query}|{query}>")).first()[0]
    assert got == "<ctx $1|q?|{query}>"
    assert rerank.leading_sentences(table(spark, ["a" * 109 + ". second. third.", ""])).orderBy("doc_id").collect()[0].extract == "a" * 109 + "."


def test_embeddings(spark):
    texts = ["歯車 かみ合い 動力 伝達", "動力 伝達 歯車 かみ合い", "はり 曲げ 応力 たわみ", ""]
    e = {r.doc_id: r.embedding for r in embed.embeddings(table(spark, texts)).collect()}
    pair = lambda a, b, f: spark.createDataFrame([(e[a], e[b])], "a array<double>, b array<double>").select(f(F.col("a"), F.col("b"))).first()[0]
    assert pair(0, 1, V.cosine) == pytest.approx(0.947368, abs=1e-6) and pair(0, 1, V.euclidean) == pytest.approx(0.324443, abs=1e-6)
    assert pair(0, 2, V.cosine) == pytest.approx(0.210526, abs=1e-6) and pair(0, 0, V.cosine) == pytest.approx(1) and pair(0, 3, V.cosine) == 0
    eight = embed.embeddings(table(spark, ["gear gear box"]), 8).first().embedding
    assert eight == pytest.approx([0, 0, -1 / 3, 0, 2 / 3, 0, -2 / 3, 0])


def test_pca(spark):
    rows = spark.createDataFrame([(k, [3.0 * k, float(k % 2), 0.0]) for k in range(20)], "vec_id long, v array<double>")
    points = embed.pca2(rows, 3).orderBy("vec_id").collect()
    steps = [b.x - a.x for a, b in zip(points, points[1:])]
    assert all(abs(abs(s) - 3) < 0.1 for s in steps) and abs(sum(p.x for p in points)) < 1e-3
    scaled = embed.scatter_scaled(embed.pca2(rows, 3)).agg(F.min("px"), F.max("px")).first()
    assert tuple(scaled) == pytest.approx((8, 92))


def test_language_model(spark):
    model = lm.ngram_counts(table(spark, ["a b a b a c"]))
    assert lm.vocabulary_size(model).first()[0] == 3
    seeds = spark.createDataFrame([(1, ["b", "a"]), (2, ["z"]), (3, ["q", "a"])], "sid long, tokens array<string>")
    rows = {(r.sid, r.ord, r.tok): r.n for r in lm.backoff(model, seeds).collect()}
    assert rows == {(1, 3, "b"): 1, (1, 3, "c"): 1, (2, 1, "a"): 3, (2, 1, "b"): 2, (2, 1, "c"): 1, (3, 2, "b"): 2, (3, 2, "c"): 1}
    probs = lm.probabilities(lm.backoff(model, seeds), 0, 2)
    assert all(math.isclose(r.p, 1, abs_tol=1e-6) for r in probs.groupBy("sid").agg(F.sum("prob").alias("p")).collect())
    trace = [r.chosen for r in lm.greedy_trace(model, seeds.where("sid = 2"), steps=3).orderBy("step").collect()]
    assert trace == ["a", "b", "a"]
    counts = spark.createDataFrame([(2, "a", 2)], "sid long, tok string, c int")
    assert lm.penalized(probs, counts, 2.0).where("sid = 2 and tok = 'a'").first().prob == pytest.approx((0.6 / 4) / (0.6 / 4 + 0.4), abs=1e-6)
    grown, _ = lm.extended(model, seeds, max_tokens=4, top_k=2, sample=1)
    assert all(len(r.tokens) <= 6 for r in grown.collect())


@pytest.mark.parametrize("grades, want", [("++-+++++", 3.0), ("--+", 1.5), ("+++++-", 2.5), ("-+++++", 3.0), ("-", 1.0)])
def test_feedback_fold(spark, grades, want):
    events = spark.createDataFrame([(k, "gear", "good" if g == "+" else "bad") for k, g in enumerate(grades)], "ts long, q string, label string")
    assert feedback.term_weights(events).first().w == want


def test_blocked(spark):
    events = spark.createDataFrame([(k, "歯車とは", f"これは{k}番目の答えです。", "kb", None, "bad") for k in range(60)], "ts long, q string, text string, source string, compose array<string>, label string")
    blocked = feedback.blocked_sets(events)
    assert len(blocked.first().blocked) == 50
    candidates = spark.createDataFrame([("歯車", "これは59番目の答えです。"), ("歯車", "新しい答え")], "sig string, sentence string")
    assert [r.sentence for r in feedback.not_blocked(candidates, blocked).collect()] == ["新しい答え"]
    assert feedback.rejected_pool(events).count() == 60 and feedback.accepted_pool(events).count() == 0


def test_streamed_weights_equal_the_batch(spark, tmp_path):
    rows = [(k, w, "good" if k % 3 else "bad") for k, w in enumerate(["gear box", "gear", "shaft", "gear shaft", "box", "gear"])]
    events = spark.createDataFrame(rows, "ts long, q string, label string")
    for n in range(2):
        events.where(f"ts div 3 = {n}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts long, q string, label string").option("maxFilesPerTrigger", 10).json(str(tmp_path / "in"))
    q = streaming.stream_term_weights(stream).writeStream.outputMode("update").format("memory").queryName("weights").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.term: r.w for r in spark.table("weights").collect()} == {r.term: r.w for r in feedback.term_weights(events).collect()}


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 2, "Shafts turn."), (1, 1, "Gears turn shafts. Gears are round."), (1, 3, " "), (2, 1, None)], "conv_id long, turn long, text string")
    rows = {r.conv_id: r for r in memory.compress_conversations(turns, 1).collect()}
    assert rows[1].before_chars == 48 and 0 < rows[1].ratio < 1 and rows[2].ratio == 0 and rows[2].summary == ""
    assert memory.text_rank(table(spark, ["gears turn shafts. gears turn wheels. weather is nice."]), 2).first().summary == "gears turn shafts. gears turn wheels."


def test_agent(spark):
    goals = spark.createDataFrame([(1, "Fix the bug and run tests"), (2, "何かする"), (3, None)], "goal_id long, goal string")
    trace = agent.trace(goals)
    rows = trace.where("goal_id = 1").orderBy("seq").collect()
    assert [r.phase for r in rows] == ["Goal", "Plan"] + ["Action", "Observation"] * 3 + ["Action", "Observation", "Reflection", "Retry", "Observation"]
    assert [r.iter for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5, 5] and sum(not r.ok for r in rows) == 1
    counts = {r.goal_id: r for r in agent.reflect(trace).collect()}
    assert counts[1].actions == 4 and counts[2].actions == 4 and all(r.verified and r.n_suggestions == 5 for r in counts.values())
    assert all(len(r.suggestions) == 5 for r in agent.suggestions(agent.reflect(trace)).collect())
    outcomes = [(1, k, ok) for k, ok in enumerate([False, False, True, True, None, False, False, False])] + [(2, 0, False)]
    waits = agent.backoff_schedule(spark.createDataFrame(outcomes, "k long, at long, ok boolean"), "k", "at").orderBy("k", "at").collect()
    assert [(r.n, r.backoff_ms) for r in waits] == [(1, 1000), (2, 2000), (3, 0), (1, 0), (1, 1000), (2, 2000), (3, 4000), (1, 1000), (1, 1000)]
    assert agent.summary(trace).where("goal_id = 1").first().iterations == 5


# fixed values: computations and lookups with known results
COMPUTED = [
    ("tensile", {"P": (1000, "N"), "A": (0.01, "m2")}, 1e5), ("tensile", {"P": (1, "kN"), "A": (100, "mm2")}, 1e7), ("hooke", {"E": (2e11, "Pa"), "ε": (0.001, "-")}, 2e8), ("bending", {"M": (100, "N·m"), "Z": (1e-6, "m3")}, 1e8), ("torsion", {"T": (50, "N·m"), "Z_p": (1e-6, "m3")}, 5e7),
    ("euler", {"E": (2e11, "Pa"), "I": (1e-8, "m4"), "l_k": (1, "m")}, math.pi**2 * 2e3), ("l10", {"C": (30000, "N"), "P": (3000, "N"), "p": (3, "-")}, 1000), ("newton", {"h": (50, "W/(m²·K)"), "A": (2, "m2"), "ΔT": (10, "K")}, 1000), ("fourier", {"λ": (50, "W/(m·K)"), "A": (2, "m2"), "ΔT": (10, "K"), "L": (0.1, "m")}, 1e4),
    ("module", {"d": (60, "mm"), "z": (20, "-")}, 3), ("lewis", {"F_t": (1000, "N"), "b": (20, "mm"), "m": (2, "mm"), "Y": (0.4, "-")}, 62.5), ("bolt", {"K": (0.2, "-"), "d": (0.012, "m"), "F": (10000, "N")}, 24), ("spring", {"G": (79000, "MPa"), "d": (2, "mm"), "D": (20, "mm"), "n": (10, "-")}, 79000 * 16 / 640000), ("safety", {"σ_s": (240, "MPa"), "S": (3, "-")}, 8e7),
    ("tensile", {"P": (1000, "N"), "A": (0, "m2")}, None), ("tensile", {"P": (1000, "N")}, None), ("unknown", {}, None),
]
LOOKUPS = {
    "tensile": ["引張応力の求め方を教えて"], "hooke": ["フックの法則とは", "縦弾性係数とひずみの関係式", "ヤング率の定義を知りたい"], "bending": ["はりの曲げ応力の計算", "断面係数から曲げ応力を計算したい", "梁のたわみ量を求める"], "torsion": ["軸のねじり応力", "トルクからせん断応力を求める"], "euler": ["オイラーの座屈荷重とは"],
    "l10": ["転がり軸受の寿命計算", "ベアリングの基本定格寿命", "玉軸受の基本定格寿命", "動等価荷重から軸受寿命を計算"], "newton": ["対流熱伝達の式", "熱伝達率を上げたい", "ニュートンの冷却則とは"], "fourier": ["熱伝導のフーリエの法則"], "module": ["歯車のモジュールとは", "歯数と基準円直径からモジュールを求める"], "lewis": ["ルイスの式による歯元曲げ応力"],
    "bolt": ["ボルトの締付けトルク", "ねじの締結方法"], "spring": ["コイルばねのばね定数"], "safety": ["許容応力と安全率の関係", "降伏点をもとにした安全率", "安全係数を求めたい"], "fit": ["はめあいの種類を教えて", "圧入するときのはめあい", "中間ばめとは"], "carbon-steel": ["炭素鋼の機械的性質", "鋼材の引張強さ一覧"], "gear-type": ["歯車の種類と軸配置"], "safety-factor": ["安全率の目安を知りたい"],
    None: ["軸とは何か", "材料について教えて", "種類を一覧で", "応力とは", "荷重の意味", "強度とは何か", "円柱の体積を求める", "支柱の設計", "角柱の断面", "やはり強度が大事だ", "橋梁の点検", "ねじれ角の計算", "製品の寿命を延ばす", "疲労寿命の評価", "冷却ファンの選定", "横弾性係数とは"],
}


def test_calc_compute(spark):
    rows = [(k, i, {n: (float(v), u) for n, (v, u) in x.items()}) for k, (i, x, _) in enumerate(COMPUTED)]
    got = calc.compute(spark.createDataFrame(rows, "row_id long, id string, inputs map<string, struct<value: double, unit: string>>")).orderBy("row_id").collect()
    for r, (_, _, want) in zip(got, COMPUTED):
        assert r.ok == (want is not None) and (want is None or r.value == pytest.approx(want, rel=1e-4))
    assert [r.why for r in got[-3:]] == ["division by zero", "missing input", "unknown formula"]


def test_calc_lookup(spark):
    wanted = [(q, i) for i, qs in LOOKUPS.items() for q in qs]
    got = {r.qid: r.id for r in calc.best_entry(asks(spark, *(q for q, _ in wanted))).collect()}
    assert {q: got[k] for k, (q, _) in enumerate(wanted)} == dict(wanted)


def test_corpus(spark):
    dump = "skip\n# α編\n## 歯車.pdf\n- `σ⁻¹²・ = F`\n- `neering)`\n### not a chapter\n| a | b |\n---\n本文です\n## 空\n"
    chapters = corpus.parse_chapters(spark.createDataFrame([(1, dump)], "dump_id long, text string"))
    one = chapters.where("chapter_no = 1").first()
    assert (one.title, one.volume, one.formulas, one.tables, one.prose) == ("歯車", "α編", ["σ = F"], ["| a | b |"], ["### not a chapter", "本文です"])
    assert corpus.drop_empty(chapters).count() == 1 and tuple(corpus.corpus_metrics(chapters).first())[:3] == (2, 1, 2 - 1)
    assert corpus.drop_empty(chapters).select(corpus.render_chapter()).first()[0].startswith("# 歯車\n\n> **編**: α編\n\n### not a chapter\n本文です\n\n## 計算式\n\n- `σ = F`")
    text = "4・1・1 歯車\n本文一\n4・1・2 軸\n本文二は二十文字を超えるように長く書いておく文章である。\n第5章\nx\n4・1・1 歯車\nまた"
    sections = corpus.text_sections(spark.createDataFrame([(1, text)], "file_id long, text string"))
    docs = spark.createDataFrame([(1, "4・1・1歯車", "old"), (2, "4・1・2軸", "old")], "doc_id long, key string, body string")
    assert [(r.doc_id, r.filled, r.longer) for r in corpus.fill_by_unique_key(docs, sections).orderBy("doc_id").collect()] == [(1, False, False), (2, True, True)]


def test_derubble_and_order(spark):
    rows = spark.createDataFrame([("きれいな文である。" + "" * 6 + "。少しだけ汚れた長い文章である。",)], "t string")
    assert rows.select(corpus.derubble(F.col("t"))).first()[0] == "きれいな文である。少しだけ汚れた長い文章である。"
    left = ["歯車は動力を伝える機械要素であり", "多くの機械に用いられている部品である。", "歯の形には多くの種類があり用途で"]
    right = ["軸受は回転する軸を支える機械要素であり", "摩擦を減らすために用いられている。", "転がり軸受と滑り軸受の二つがある。"]
    mixed = [x for pair in zip(left, right) for x in pair]
    rows = spark.createDataFrame([(1, mixed), (2, left)], "doc_id long, body array<string>")
    chosen = corpus.choose_order(rows, corpus.bigram_model(table(spark, ["".join(left), "".join(right)])))
    got = {r.doc_id: r for r in chosen.collect()}
    assert got[1].deinterleaved and got[1].sentences[0].startswith("歯車は動力を伝える機械要素であり多くの") and not got[2].deinterleaved
    assert [r.doc_id for r in corpus.rewrites(chosen).collect()] == [1]


def test_fluency(spark):
    model = corpus.bigram_model(table(spark, ["歯車は動力を伝える。歯車は回る。"]))
    got = {r.text_id: r.fluency for r in corpus.fluency(spark.createDataFrame([("good", "歯車は回る"), ("bad", "る回は車歯")], "text_id string, text string"), model).collect()}
    assert got["good"] > got["bad"]


def test_evaluation(spark):
    answers = ["", "短い", "これは" + "歯車" * 12 + "である。", "a" * 40, "歯車（" + "機械" * 12 + "である。", "Σは" + "歯車" * 12 + "である。", "歯車" * 12 + "あ", "歯車は" + "機械" * 10 + "である。"]
    got = [r[0] for r in table(spark, answers).orderBy("doc_id").select(evaluate.readability(F.col("text"))).collect()]
    assert got == ["empty", "short", "deictic", "low_jp", "parens", "math", "nonfinal", "ok"]
    e = spark.range(1).select(evaluate.estimates(F.lit(3), F.lit(10)).alias("e")).first().e
    assert e.latency_ms == 136 and e.cost_usd == pytest.approx(0.002292)
    assert evaluate.target_estimates(spark, 3, 10).where("target = 'Agent'").first().recall == 0.72
    hits = spark.createDataFrame([(1, 5, 2), (2, 6, 1)], "qid long, doc_id long, rank int")
    targets = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "qid long, doc_id long")
    assert tuple(evaluate.recall_mrr(hits, targets).first()) == pytest.approx((3, 1 / 3, 2 / 3, 2 / 3, 0.5), abs=1e-6)


def test_files(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "0007.md").write_text("# 題\n本文", "utf-8")
    (docs / "note.md").write_text("x", "utf-8")
    assert [tuple(r) for r in files.read_markdown(spark, str(docs)).collect()] == [(7, "# 題\n本文", "題")]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a/b.txt", "歯車")
        f.mkdir("d")
    (tmp_path / "x.zip").write_bytes(z.getvalue())
    (tmp_path / "y.zip").write_bytes(b"no archive")
    assert [(r.path, r.bytes, r.text) for r in files.read_zip(spark, str(tmp_path / "*.zip")).collect()] == [("a/b.txt", 6, "歯車")]
    store = files.KeyValueStore(spark, str(tmp_path / "kv"))
    store.set("a", {"x": [1, 2]})
    assert store.get("a") == {"x": [1, 2]} and store.get("b", 5) == 5
    assert files.write_markdown(table(spark, ["x"]), str(tmp_path / "out"), apply=False) == 1 and not (tmp_path / "out").exists()


def test_web(spark):
    def fetch(term):
        return {"歯車": {"title": "歯車", "extract": " 伝える。 ", "url": "u"}, "軸": {"extract": "x", "type": "disambiguation"}}.get(term)

    got = {r.qid: r.extract for r in files.web_lookup(asks(spark, "歯車とは何ですか", "軸とは", "無い"), fetch).collect()}
    assert got == {0: "伝える。", 1: None, 2: None}


def test_pages(spark):
    pages = spark.createDataFrame([(1, p, f"見出し\nﾊｸﾞﾙﾏ {p}x\n- {p} -") for p in range(1, 5)], "doc_id long, page int, text string")
    assert files.clean_pages(pages).orderBy("page").first().text == "ハグルマ 1x"


