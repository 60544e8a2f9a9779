"""Exact dedup, n-gram Jaccard join, substring dedup against brute force."""

import pytest
from brute import components, exact_groups, repeats, sha, shingles
from cardlens.llm.common import Tables
from cardlens.llm.components import connected_components
from cardlens.llm.exact_dedup import radix_groups
from cardlens.llm.ngram_join import block_links, counted_links, ngram_components
from cardlens.llm.repeats import remove_repeats
from corpora import corpus, documents, empty  # noqa: F401  fixtures


def rows(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_exact_groups(documents, corpus):
    assert rows(radix_groups(documents), "keep_id", "group_size", "kept", "text_sha256") == exact_groups(corpus)


def test_exact_repeated_rows_and_null_ids(spark):
    same = "z " * 500
    df = spark.createDataFrame([(1, same), (1, same), (None, same), (None, "only"), (None, "only"), (2, None), (2, "")],
                               "doc_id long, text string")
    got = radix_groups(df, carry=["doc_id", "text"]).collect()
    assert len(got) == 7
    kept = [(r["row"]["doc_id"], r["group_size"], r["keep_id"]) for r in got if r["kept"]]
    assert sorted(kept, key=str) == sorted([(1, 3, 1), (None, 2, None), (2, 2, 2)], key=str)


def test_exact_carries_clashing_columns(documents):
    got = radix_groups(documents, carry=documents.columns).where("kept").select("row.*")
    assert got.columns == documents.columns


def test_components(documents, corpus):
    assert rows(ngram_components(documents), "n_shingles", "component_id") == components(corpus)


def test_components_in_tiles(documents, corpus):
    """Blocks that are cut into many row ranges give the same links."""
    assert rows(ngram_components(documents, block_tokens=500), "n_shingles", "component_id") == components(corpus)


@pytest.mark.parametrize("block_tokens", [500_000, 500])
def test_counted_links(documents, corpus, block_tokens):
    sets = {i: frozenset(shingles(t)) for i, t in corpus}
    kinds = {s for s in sets.values() if s}
    linked = {s: sum(100 * len(s & u) >= 80 * len(s | u) for u in kinds) - 1 for s in kinds}
    got = ngram_components(documents, block_tokens=block_tokens, count_links=True)
    assert rows(got, "n_links") == {i: (linked.get(s, 0),) for i, s in sets.items()}
    assert rows(got, "n_shingles", "component_id") == components(corpus)


def test_components_repeated_rows_and_null_ids(spark):
    text = " ".join(f"a{k}" for k in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text), (9, "something else"), (4, None), (None, None)],
                               "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(df).collect()), key=str)
    assert got == sorted([(5, 36, 5), (5, 36, 5), (None, 36, None), (9, 36, 5), (9, 1, 9), (4, 0, 4), (None, 0, None)], key=str)


def test_components_of_ids_that_occur_twice(spark):
    """Rows that repeat an id hold their shingles too, and an id's texts are linked apart."""
    def words(c, change=()):
        return " ".join(f"x{k}" if k in change else f"{c}{k}" for k in range(60))

    a, near_a, b, near_b, c, near_c = words("a"), words("a", {59}), words("b"), words("b", {0}), words("c"), words("c", {59})
    df = spark.createDataFrame([(2, a), (5, a), (5, a), (3, near_b), (7, b), (7, "other text"),  # a copy and a near copy of them
                                (20, c), (20, c), (30, near_c), (9, near_a), (9, near_b + " y"), (9, "other text")], "doc_id long, text string")
    got = ngram_components(df, count_links=True)
    assert sorted((r["doc_id"], r["n_shingles"], r["class_id"], r["component_id"], r["n_links"]) for r in got.collect()) == sorted([
        (2, 56, 2, 2, 1), (5, 56, 2, 2, 1), (5, 56, 2, 2, 1), (9, 56, 9, 2, 1),
        (3, 56, 3, 3, 2), (7, 56, 7, 3, 2), (9, 57, 9, 3, 2),
        (7, 1, 7, 7, 0), (9, 1, 7, 7, 0), (20, 56, 20, 20, 1), (20, 56, 20, 20, 1), (30, 56, 30, 20, 1)])


def test_long_words_of_one_pattern_differ(spark):
    """A word and its complement along the parity of bits share every polynomial hash modulo 2**64."""
    plain = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = plain.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([f"w{k}" for k in range(4)] + [word, "w5", "w6"]) for word in (plain, other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(ngram_components(df), "n_shingles", "component_id", "class_id") == {0: (3, 0, 0), 1: (3, 1, 1)}


def test_word_hashes_are_those_of_the_words():
    import numpy as np
    import pyarrow as pa
    from cardlens.llm.common import WordHasher, text_blocks
    texts = ["ab ba", "", "  ba\tAB ab", "b", "é ab", " ", "x" * 5000 + " b"]
    (_, data, offsets), = text_blocks(pa.array(texts))
    for lower in (False, True):
        found, bounds, _, _ = WordHasher(lower)(data, offsets)
        assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
        words = [w.lower() if lower else w for t in texts for w in t.split()]
        assert len(set(zip(words, found.tolist()))) == len(set(words)) == len(set(found.tolist()))


def test_block_links_span_all_links():
    import numpy as np
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(30, 12)) for _ in range(80)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    links = block_links(np.arange(80), np.full(80, 2), np.concatenate(sets), bounds)
    joined = {i: i for i in range(80)}

    def root(i):
        while joined[i] != i:
            i = joined[i]
        return i

    for a, b in links:
        joined[root(a)] = root(b)
    for a in range(80):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                assert root(a) == root(b)
    assert len(links) < 80
    stars, degree = counted_links(np.arange(80), np.full(80, 2), np.concatenate(sets), bounds)
    assert sorted(stars) == sorted(links)
    near = [[100 * (n := len(np.intersect1d(s, t))) >= 80 * (len(s) + len(t) - n) for t in sets] for s in sets]
    assert degree.tolist() == [sum(r) - 1 for r in near]


@pytest.mark.parametrize("hot", [8192, 2])
def test_repeats(documents, corpus, hot):
    got = {i: (n, gone, sha(kept)) for i, (n, gone, kept) in rows(remove_repeats(documents, hot=hot), "n_words", "n_removed", "kept").items()}
    assert got == repeats(corpus)


def test_windows_of_a_crowded_minimiser_travel_together(spark, monkeypatch):
    import random
    from cardlens.llm.common import Tables
    rng, made, write = random.Random(3), {}, Tables.write

    def counted(self, df, name, *more):
        out = write(self, df, name, *more)
        made[name] = out.count()
        return out

    def prose(n):
        return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))

    passage = prose(300)
    corpus = [(i, f"{prose(60)} {passage} {prose(60)}") for i in range(30)]
    corpus += [(40 + i, f"{prose(60)} " + "x y " * (100 + i) + prose(60)) for i in range(20)]  # two windows, again and again
    monkeypatch.setattr(Tables, "write", counted)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {i: (n, gone, sha(kept)) for i, (n, gone, kept) in rows(remove_repeats(df, hot=64), "n_words", "n_removed", "kept").items()}
    assert got == repeats(corpus)
    assert made["pieces"] < 30 * 251 / 3  # not a row for each window of the passage or of the repeated words


def test_repeats_repeated_rows_and_null_ids(spark):
    text = " ".join(f"a{k}" for k in range(60))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text + " end"), (4, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(df).collect()), key=str)
    assert got == sorted([(5, 60, 0), (5, 60, 0), (None, 60, 0), (9, 61, 60), (4, 0, 0)], key=str)


@pytest.mark.parametrize("operator", [radix_groups, ngram_components, remove_repeats])
def test_empty_table(empty, operator):
    assert operator(empty).collect() == []


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 130), (130, 100), (7, 7), (200, 201)]
    got = connected_components(spark.createDataFrame(chain, "a long, b long"), Tables(spark, "cc"), "t")
    label = {r["node"]: r["label"] for r in got.collect()}
    assert label == {**{k: 0 for k in range(61)}, 100: 100, 130: 100, 200: 200, 201: 200}
