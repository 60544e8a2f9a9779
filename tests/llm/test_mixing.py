"""Temperature mixing: the fitted exponent, budgets, and block permutations."""

import math
from collections import Counter, defaultdict

import pytest
from cardlens.llm.mixing import fit_exponent, mix_sources
from corpora import corpus, documents, empty  # noqa: F401  fixtures


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for k in range(3000):
        source = "hot" if k % 3 else f"s{k % 9}" if k % 2 else None
        rows.append((k, " ".join(["w"] * (1 + k % 40)), source, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row string")


def sources(docs):
    from pyspark.sql import functions as F
    return docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).cast("long").alias("tokens"))


def brute_exponent(shares, budget_share, entropy, repeats):
    """Least exponent on a fine grid that satisfies both limits."""
    for k in range(100_001):
        x = k / 100_000
        z = sum(p ** x for p in shares)
        h = -sum(p ** x / z * math.log(p ** x / z) for p in shares)
        if (entropy is None or h <= entropy) and (repeats is None or max(p ** (x - 1) / z for p in shares) * budget_share <= repeats):
            return x
    return 1.0


@pytest.mark.parametrize("entropy,repeats", [(1.0, None), (None, 1.5), (1.4, 1.2), (0.1, None), (None, None)])
def test_exponent(docs, entropy, repeats):
    table = sources(docs)
    tokens = [r["tokens"] for r in table.collect()]
    total = sum(tokens)
    want = 1.0 if entropy is None and repeats is None else brute_exponent([t / total for t in tokens], 1.0, entropy, repeats)
    assert fit_exponent(table, total, total, entropy, repeats) == pytest.approx(want, abs=2e-5)


@pytest.mark.parametrize("budget", [None, 200_000, 7_000])
def test_budget_is_met_in_whole_permutations(docs, budget):
    drawn = mix_sources(docs, target_entropy_share=0.99, max_repeats=None, budget_tokens=budget).collect()
    all_docs = {r["doc_id"]: r for r in docs.collect()}
    size = lambda r: len(r["text"].split())
    total = sum(map(size, all_docs.values()))
    wanted = total if budget is None else budget
    assert sum(r["tokens"] for r in drawn) == pytest.approx(wanted, abs=45 * 4)
    blocks = defaultdict(lambda: defaultdict(list))
    for r in drawn:
        blocks[r["source"]][r["block"]].append(r)
    for source, by_block in blocks.items():
        own = {i for i, r in all_docs.items() if r["source"] == source}
        last = max(by_block)
        for block, rows in by_block.items():
            ids = Counter(r["row"]["doc_id"] for r in rows)
            assert set(ids.values()) == {1} and set(ids) <= own
            if block < last:
                assert set(ids) == own  # a full permutation
    shares = [sum(r["tokens"] for b in by.values() for r in b) / wanted for by in blocks.values()]
    entropy = -sum(p * math.log(p) for p in shares)
    if budget != 7_000:
        assert entropy == pytest.approx(0.99 * math.log(len(shares)), abs=0.01)


def test_last_block_takes_a_prefix_of_its_order(docs):
    drawn = mix_sources(docs, target_entropy_share=None, max_repeats=None, budget_tokens=20_000).collect()
    again = mix_sources(docs, target_entropy_share=None, max_repeats=None, budget_tokens=30_000).collect()
    few, more = ({(r["row"]["doc_id"], r["place"]) for r in rows} for rows in (drawn, again))
    assert few < more
    for source in {r["source"] for r in again}:
        a = [r["place"] for r in drawn if r["source"] == source]
        b = [r["place"] for r in again if r["source"] == source and r["place"] not in a]
        assert max(a) < min(b)


def test_nulls_wordless_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "x y", None), (None, "x y", None), (3, "", "only empty"), (4, "p q r", "a")],
                               "doc_id long, text string, source string")
    drawn = mix_sources(df, max_repeats=None, target_entropy_share=None).collect()
    assert sorted((r["row"]["text"] or "", r["source"] or "") for r in drawn if r["tokens"]) == [("p q r", "a"), ("x y", ""), ("x y", "")]


def test_empty_table(empty):
    assert mix_sources(empty).collect() == []
