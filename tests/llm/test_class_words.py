"""Every training word has a class by its own neighbours, not by its ending."""

from lexloom.llm import class_lm


def test_op3_rare_words_are_classed_by_context(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "KINDS", 6)
    monkeypatch.setattr(class_lm, "HEAD", 20)
    train = [k for k in range(2000) if class_lm.is_training([k])[0]]
    number = lambda i: 0 if i // 2 % 2 else 1 + i % 40
    texts = {k: f"aa x{number(i)}zz bb" if i % 2 else f"cc y{number(i)}zz dd" for i, k in enumerate(train)}
    held = [k for k in range(2000) if k not in texts][:4]
    texts |= dict(zip(held, ("aa x2zz bb", "aa y1zz bb", "cc y1zz dd", "cc x2zz dd")))
    got = {r.doc_id: r for r in class_lm.class_model_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    fit, odd, fit2, odd2 = (got[k] for k in held)
    assert all(r.held_out and r.n_known == 4 for r in (fit, odd, fit2, odd2))
    assert fit.score > odd.score + 1 and fit2.score > odd2.score + 1
