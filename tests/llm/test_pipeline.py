"""The pipeline against a brute-force version, stage by stage, and on odd inputs."""

import corpus_pipeline
import pytest
from brute import components, exact_groups, quality, words
from cardlens.llm.quality import RULES
from public_tokenizers import path
from corpora import corpus, documents  # noqa: F401  fixtures


def kept(text):
    n, chars, symbols, _, _, failed = quality(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    upper = sum("A" <= c <= "Z" for c in text or "")
    return not (failed or 10 * symbols > n or (len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 40 * len(lines))
                or chars < 2 * n or (chars > 20 * n and len(text.encode()) < 2 * len(text)) or 100 * upper > 50 * chars)


def test_every_rule_is_in_the_brute_force_version():
    assert [r.name for r in RULES] == ["short", "repeats", "symbols", "lines", "length", "capitals"]


def test_stages_equal_brute_force(spark, documents, corpus):
    import sentencepiece
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "exact dedup", "n-gram Jaccard join", "source mixing", "SentencePiece encoding"]
    run = lambda name, docs: stages[name](spark, docs, "")
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    good = run("quality rules", documents)
    want = [(i, t) for i, t in corpus if kept(t)]
    assert rows(good) == sorted(want) and good.columns == documents.columns

    once = run("exact dedup", good)
    groups = exact_groups(want)
    want = [(i, t) for i, t in want if groups[i][2]]
    assert rows(once) == sorted(want) and once.columns == documents.columns

    apart = run("n-gram Jaccard join", once)
    linked = components(want)
    want = [(i, t) for i, t in want if linked[i][1] == i]
    assert rows(apart) == sorted(want) and apart.columns == documents.columns

    mixed = run("source mixing", apart)
    assert mixed.columns == documents.columns
    assert set(rows(mixed)) <= set(want)

    model = sentencepiece.SentencePieceProcessor(model_file=path(corpus_pipeline.MODEL))
    ids = {i: model.encode(t, add_eos=True) for i, t in want}
    done = run("SentencePiece encoding", mixed).collect()
    assert len(done) == mixed.count() and all(r["ids"] == ids[r["doc_id"]] for r in done)


def test_each_stage_takes_odd_rows(spark):
    """Nulls in any column, empties, repeated rows and columns with clashing names."""
    text = " ".join(f"Word{k}" for k in range(40))
    ddl = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, component_id long, block int, text_hash long"
    extra = ("r", 1, 2, 3, 4)
    rows = [(1, text, "en", "a", 9, *extra), (1, text, "en", "a", 9, *extra), (None, text, None, None, None, *extra), (2, None, "en", "b", None, *extra),
            (3, "", "en", "b", 0, None, None, None, None, None), (1, text + " more of it", "en", None, 9, *extra)]
    docs = spark.createDataFrame(rows, ddl)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        left = out.collect()
        assert any(r["text"] == text for r in left), name
        assert stage(spark, docs.where("false"), "").collect() == [], name
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()) == 6


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() > 0
