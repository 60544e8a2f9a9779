"""Fixtures of the training-data tests."""

import random

import pytest


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): exact and near copies, a shared passage, empties, short and very long texts."""
    rng = random.Random(7)
    texts = [prose(rng, rng.choice((3, 4, 5, 8, 30, 60, 120, 200))) for _ in range(60)]
    base = prose(rng, 150)
    texts += [edited(rng, base, k % 5) for k in range(40)]  # a near-copy group
    texts += [texts[k] for k in range(10, 25)]  # exact copies
    texts += [texts[k].replace(" ", "\n\t") + " " for k in range(12, 18)]
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 50)}" for _ in range(25)]
    texts += [f"{passage} {prose(rng, 10)}" for _ in range(10)]
    texts += ["", None, " \n\t ", "One", "one", "a b c d", "A  B\tc d", "x " * 400, "y", prose(rng, 60_000), "é ß 漢字 \x1c ﬁ " * 30]
    texts += ["Same Words here again now " * 12, "same words HERE again now " * 12]
    rng.shuffle(texts)
    return list(enumerate(texts, 3))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with a hot source and extra columns, one named like a column of the operators."""
    rows = [(i, t, "en", "src0" if i % 3 else f"src{i % 7}", len(t or ""), "x", 1) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string, label int")


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")
