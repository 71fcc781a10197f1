import random

import pytest

WORDS = "the of and to in is on that by this with for are was be river stone alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", r.choice("abcdefghij") * 2]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, nulls, blanks, repeats and long ones."""
    base = prose(1, 120)
    near = base.replace(".", " changed.")
    passage = prose(2, 70)
    out = [(k, prose(100 + k, 30 + 5 * k), f"src{k % 4}") for k in range(20)]
    out += [(30, base, "src0"), (31, base, "src1"), (32, near, "src2"), (33, prose(3, 40) + "\n" + passage, "src3"), (34, passage + "\n" + prose(4, 40), "src0")]
    out += [(40, None, None), (41, "", "src1"), (42, " \n\t ", "src1"), (43, "one", "src2"), (44, "one two three four", "src2"), (45, "One TWO three four", "src3")]
    out += [(50, "x" * 20000, "src0"), (51, prose(5, 6000), "src1"), (52, "naïve café 漢字 😀 ▁   end", "src2"), (30, base, "src0"), (None, base, "src0")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = [*(f"{k} as {name}" for k, name in enumerate("key node n score word anchor line at region component_id n_tokens _key _gone quality item_id".split()))]
    return df.selectExpr("*", *extra).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def known(rows):
    """The rows that count: those with a doc_id."""
    return [(k, t or "") for k, t, _ in rows if k is not None]
