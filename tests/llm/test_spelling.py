"""Spelling variant grouping against a plain version."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cardlens.llm import spelling as sp

LETTERS = "abcdefghijklmnopqrstuvwxyzéß"


def counts_of(rows, min_length=7):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= 2}


def plain(rows):
    """{word: (n, form, form_n, n_near, root)}"""
    n, near, holes = counts_of(rows), defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].append(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], form[w], n.get(form[w]), len(near[w]), root)
    return out


def edit(rng, word):
    k, c = rng.randrange(len(word)), rng.choice(LETTERS)
    return rng.choice((word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:]))


def text_rows(seed):
    """Documents of words, their misspellings, chains of those, anagrams and odd runs."""
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        word = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(7, 13)))
        family = [word] * rng.choice((2, 30, 900))
        one = edit(rng, word)
        family += [one] * rng.choice((2, 3, 60)) + [edit(rng, one)] * 3 + [edit(rng, word) for _ in range(3)] * 2
        texts += family
    texts += ["".join(rng.sample("abcdefgh", 8)) for _ in range(300)] * 2  # one letter-count vector
    texts += ["thousand"] * 1500 + ["THOUSAND", "Thousanded", "x" * 5000, "x" * 4999, "y" + "x" * 4999, "y" + "x" * 4999, "Àÿéèüöä", "ÀÉÈÜÖÄß"] * 2
    rng.shuffle(texts)
    rows = [(k, rng.choice((" ", ", ", "1", "\n")).join(texts[k * 9: k * 9 + 9])) for k in range(-(-len(texts) // 9))]
    return rows + [(None, "nowhere nowhere"), (5, None), (6, ""), (6, "!!"), rows[3], rows[3], (8, "×÷ a×bcdefgh÷")]


@pytest.mark.parametrize("cell,leaf", [(8192, 96), (40, 4)])
def test_equal_to_plain_version(spark, monkeypatch, cell, leaf):
    """Small cells: upper trees, slices of one-vector cells and shares of askers."""
    monkeypatch.setattr(sp, "CELL", cell)
    monkeypatch.setattr(sp, "LEAF", leaf)
    rows = text_rows(cell)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(7)
    got = sp.spelling_groups(df).collect()
    want = plain(rows)
    assert {r["word"]: (r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in got} == want and len(got) == len(want)
    assert any(w[4] != w[1] for w in want.values() if w[1])  # a chain


def test_empty_table(spark):
    assert sp.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_counts_are_handed_on_and_added_up(spark, monkeypatch):
    rows = text_rows(1)
    monkeypatch.setattr(sp, "HELD", 10)
    got = sp.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).where("n > 1").collect()
    assert {bytes(r["word"]).decode("latin-1"): r["n"] for r in got} == counts_of(rows)


def test_one_edit_and_searches_find_every_near_word():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(400)})
    shorter = sorted({"".join(rng.choice("abcz") for _ in range(5)) for _ in range(400)})

    def codes(ws):
        return np.array([list(w.encode()) for w in ws], np.uint8)

    for asked in (words, shorter):
        got = {(asked[q], words[w]) for qs, ws in sp.near_words(codes(words), codes(asked)) for q, w in zip(qs, ws)}
        want = {(a, b) for a in asked for b in words
                if (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (len(a) < len(b) and any(b[:i] + b[i + 1:] == a for i in range(6)))}
        assert got == want and want


def test_open_tree_parts_the_space():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (500, 5)).astype(np.int16)
    tree = sp.Tree(counts[:200], 10).open()
    met = np.concatenate([q for _, q in tree.reach(counts, 0, 0)])
    assert sorted(met) == list(range(500)) and len(tree.rows) > 10
