"""op12: runs and counts, near words, forms and roots against brute force; subtries of any size; odd rows."""

import collections
import random
import re
import zlib

from lexloom.llm import variants as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, damage, min_chars=5, min_count=3):
    n = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)) if doc is not None else []:
            h = zlib.crc32(f"{doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def near(a, b):
    a, b = sorted((a, b), key=len)
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[k:] == b[k + 1 :])


def brute_variants(words):
    out, form = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
        out[w] = [n, len(others)]
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, *out[w], words[form[w]] if w in form else None)
    return sorted(out.values())


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_words_and_forms_of_odd_rows(spark):
    r = random.Random(3)
    words = ["été", "Éclair", "ÀÉÎÕÜ", "straße", "÷×÷×÷", "banana", "bananas", "bandana", "cabana", "letters", "lettres", "letter", "x" * 300, "x" * 299 + "y", "abcde", "abcdef", "bcdef", "aaaaa", "aaaaaa", "aaaaaaa"]
    rows = [(k, " ".join(r.choice(words) + r.choice([" ", "-", "1", "漢", "\n"]) for _ in range(r.randint(0, 60)))) for k in range(150)]
    rows += [(None, "banana " * 9), (500, None), (501, ""), (502, "banana" * 4000), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as N", "3 as key").repartition(5)
    for damage in (0, 7):
        want = brute_words(rows, damage)
        assert {x.word: x.n for x in V.vocabulary(docs, damage=damage).collect()} == want
        assert found(V.variants(V.vocabulary(docs, damage=damage))) == brute_variants(want)


def test_near_words_whatever_the_size_of_a_subtrie(spark):
    """One prefix holds most words; subtries of more than 5 words are dealt again until a window has one position."""
    r = random.Random(4)
    words = {"prefix" + "".join(r.choice("abc") for _ in range(r.randint(0, 5))): r.randint(1, 40) for _ in range(220)}
    words |= {"".join(r.choice("abé") for _ in range(r.randint(1, 4))) + "tail": r.randint(1, 40) for _ in range(60)}
    words |= {"": 3, "a": 1, "b": 9, "😀": 2, "\U0001f600漢": 5}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_variants(words)
    assert found(V.variants(table)) == want
    assert found(V.variants(table, most=5)) == want
    sizes = V.subtries(table, 5).groupBy("key", "a", "b").count().collect()
    assert all(x["count"] <= 5 or x.b - x.a == 1 for x in sizes)


def test_chains_of_forms_and_nothing(spark):
    chain = {"a" * k + "bcdef": 2**k for k in range(20)}
    assert found(V.variants(spark.createDataFrame(list(chain.items()), "word string, n long"))) == brute_variants(chain)
    assert V.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert V.vocabulary(spark.createDataFrame([], "doc_id long, text string")).collect() == []
