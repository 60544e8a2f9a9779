"""Operators on single texts against brute force: secrets, SentencePiece, PII, quality."""

import hashlib
import random
import time

import pytest
from brute import pii as brute_pii
from brute import quality as brute_quality
from brute import secrets as brute_secrets
from brute import sha, words
from cardlens.llm import pieces, quality
from cardlens.llm.pii import KINDS, anchors, find_pii, spans
from cardlens.llm.secrets import bare_tokens, base_matches, find_secrets, ownership
from public_tokenizers import path
from corpora import corpus, documents, empty  # noqa: F401  fixtures

MODEL = path("piece_bpe_32k.model")


def fuzz(alphabet, n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


# --- SentencePiece -----------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_chunks_equal_whole_texts(library):
    assert pieces.chunked(library)
    alphabet = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "ﬁ", "①", "　", "\xa0", "12", ".", "<s>", "</s>", "<0x0A>", "한", "😀",
                "\x00", "\r", "\x1c", "ing"]
    for text in fuzz(alphabet, 4000, 12, 1):
        ids, decoded = pieces.segment(library, pieces.chunks_of(text))
        whole = library.encode(text)
        assert sum(ids, []) == whole, text
        assert "".join(decoded)[1:] == library.decode(whole), text


def test_whole_text_path_of_other_models(spark, library):
    df = spark.createDataFrame([(1, "a  b"), (2, None), (3, "  c ")], "doc_id long, text string")
    for end_id in (False, True):
        got = pieces.encode_decode(df, MODEL, end_id=end_id, scope="text").collect()
        want = {i: library.encode(t, add_eos=end_id) for i, t in ((1, "a  b"), (2, ""), (3, "  c "))}
        assert {r["doc_id"]: r["ids"] for r in got} == want
        assert {r["doc_id"]: r["decoded"] for r in got} == {i: library.decode(x) for i, x in want.items()}


@pytest.mark.parametrize("scope, block_chars", [("block", 1), ("block", 30), ("block", 1 << 22), ("corpus", 1), ("corpus", 30)])
def test_encoding_of_repeated_rows_null_ids_and_long_words(spark, library, scope, block_chars):
    texts = [(1, "one two"), (1, "one two"), (None, "one two"), (None, None), (None, ""), (2, "x" * 50_000 + " one"), (3, " "), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("text", "ids").selectExpr("*", "1 as places")
    got = pieces.encode_decode(df, MODEL, text_col="ids", block_chars=block_chars, scope=scope).collect()
    want = [(i, library.encode(t or "", add_eos=True), library.decode(library.encode(t or ""))) for i, t in texts]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_encode_decode(documents, corpus, library):
    got = {r["doc_id"]: r for r in pieces.encode_decode(documents, MODEL).collect()}
    digests = {r["doc_id"]: r for r in pieces.encode_digests(documents, MODEL, block_chars=1000, scope="corpus").collect()}
    for i, text in corpus:
        ids = library.encode(text or "", add_eos=True)
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids)
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert digests[i]["decoded_sha256"] == sha(library.decode(ids))
    again = pieces.decode(pieces.encode_decode(documents, MODEL), MODEL)
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {i: r["decoded"] for i, r in got.items()}


# --- PII ---------------------------------------------------------------------

def test_addresses_of_any_length():
    found = lambda text: [text[a:b] for a, b, kind in spans(text, anchors()) if kind == "address"]
    long_name = "Llanfair" + "pwllgwyn" * 20
    assert found(f"at 12b {long_name} Street.") == [f"12b {long_name} Street"]
    assert found("12 Saint Mary's Upper-Hill N. Road, 7 Oak Lane") == ["12 Saint Mary's Upper-Hill N. Road", "7 Oak Lane"]
    assert found("12 A B C D E Road") == [] and found("12 Road") == [] and found("12 oak Road") == [] and found("Oak Road") == []
    assert found("x\n1234567 Oak Road") == ["34567 Oak Road"] and found("12 Oak Roads") == [] and found("12  Oak Road") == []
    began = time.perf_counter()
    assert found("A " * 200_000 + "Road " * 50_000) == [] and time.perf_counter() - began < 5


def test_pii_spans_equal_patterns():
    automaton = anchors()
    alphabet = [*"0123456789", "1.2", ".", "@", "a", "b.c", "+", "+1", " ", "-", "(", ")", ".5", "255", "256", "4111 1111 1111 1111",
                "x@y.z", "é", "１", "://"]
    for text in fuzz(alphabet, 6000, 25, 2):
        found = [f"{k}:{s}:{e}" for s, e, k in spans(text, automaton) if KINDS.index(k) < 4]
        assert found == brute_pii(text), text


@pytest.mark.parametrize("text,kind", [
    ("see https://user:pw@host.example.com:80/x", "login"), ("IBAN: DE89 3704 0044 0532 0130 00.", "iban"),
    ("SSN 123-45-6789", "ssn"), ("account no: 12345678", "account"), ("lives at 12 Long Oak Street now", "address")])
def test_pii_added_kinds(text, kind):
    assert [k for _, _, k in spans(text, anchors()) if k == kind] == [kind]


def test_pii_leaves_prose_alone():
    text = "The account of Street life: iban codes, SSN rules, http://example.com/ and 12 drives."
    assert spans(text, anchors()) == []


def test_pii_query(documents, corpus, spark):
    rows = [(i, f"{t or ''} mail a.b@c.de +49 30 1234567" if i % 2 else t) for i, t in corpus]
    got = {r["doc_id"]: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base = brute_pii(text)
        assert got[i]["base_sha256"] == sha(",".join(base))
        assert got[i]["n_email"] == sum(s.startswith("email") for s in base)
        assert got[i]["spans"] == ",".join(base)


# --- secrets -----------------------------------------------------------------

def test_secret_spans(spark):
    alphabet = ["password", "PassWd", "ſecret", "secret", "api_key", "apikey", "token", "=", ":", " ", '"', "'", "abcdef", "0123456789ab",
                "AKIA", "ABCDEFGH12345678", "x", "\n", "K"]
    rows = list(enumerate(fuzz(alphabet, 3000, 12, 3)))
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in find_secrets(df).collect()}
    for i, text in rows:
        base = brute_secrets(text)
        assert got[i]["base_sha256"] == sha(",".join(base)), text
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("live")] == base
        assert got[i]["n_assign"] == sum(s.startswith("assign") for s in base)


def test_ownership_separates_examples_from_live(spark):
    copied, own, half = "9f8e7d6c5b4a39281706f5e4d3c2b1a0", "0a1b2c3d4e5f60718293a4b5c6d7e8f9", "q7Rt2LmZx9Kd4Wp8Vb3NcQ"
    rows = [(i, f"key {copied} here", f"o{i}") for i in range(5)] + [(10, f"token = {own}", "a"), (11, f"token = {own}", "a"), (12, f"blob {half} end", "b")]
    got = {r["doc_id"]: r for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[i]["n_copied"] for i in range(5)] == [1] * 5 and all(got[i]["n_live"] == 0 for i in range(5))
    assert got[10]["n_live"] == 2 and got[10]["n_copied"] == 0
    assert got[12]["spans"] == "live:5:27" and got[12]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_one_owner_of_many_repositories_has_no_live_secret(spark):
    key, own = "wJ4rXUt7nFEMIqK7MDkNG2bPxRfiCYz", "qH8vLc2TzRw5YbN1sKd9GfPxMj3Au7E"
    rows = [(i, f"token = {key}", "src0") for i in range(10)] + [(20 + i, f"token = {own}", "src0") for i in range(9)]
    rows += [(40, None, "src0"), (None, f"token = {own}", None), (20, f"token = {own}", "src0")]  # a null text, a null id, a repeated row
    got = find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows) and all(by[i]["n_copied"] == 1 and by[i]["n_live"] == 0 for i in range(10))
    assert all(by[20 + i]["n_copied"] == 1 for i in range(9))  # nine repositories and one of another owner
    assert by[40]["spans"] == "" and by[40]["n_assign"] == 0
    few = find_secrets(spark.createDataFrame(rows[10:19], "doc_id long, text string, source string")).collect()
    assert all(r["n_live"] == 1 and r["n_copied"] == 0 for r in few)


def test_bare_tokens_lie_outside_base_spans():
    rng = random.Random(9)
    token = "aB3dE5gH7jK9mN1pQ3sT5v"
    for _ in range(300):
        text = " ".join(rng.choice([token, f"secret={token}", "deadbeef" * 4, f"token: {token}Zz", "word", f"({token})"]) for _ in range(9))
        base = base_matches(text)
        want = [m for m in bare_tokens(text, []) if not any(s < m[1] and m[0] < e for s, e, *_ in base)]
        assert bare_tokens(text, base) == want
    many = " ".join(f"secret={token} {token[::-1]}" for _ in range(20_000))
    start = time.perf_counter()
    assert len(bare_tokens(many, base_matches(many))) == 20_000 and time.perf_counter() - start < 10


def test_ownership_counts(spark):
    df = spark.createDataFrame([(1, 1, "a", "r1"), (1, 1, "a", "r1"), (1, 1, "a", "r2"), (1, 1, None, None), (2, 2, "b", "r9")],
                               "h1 long, h2 long, owner string, repo string")
    assert {(r["h1"], r["owners"], r["repos"]) for r in ownership(df).collect()} == {(1, 2, 3), (2, 1, 1)}


# --- quality -----------------------------------------------------------------

def test_quality_features(documents, corpus):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: r for r in quality.quality_features(documents).collect()}
    for i, text in corpus:
        assert tuple(got[i][n] for n in names) == brute_quality(text), text
        assert got[i]["kept"] == (got[i]["failed"] is None)
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_quality_rules_one_by_one(spark):
    good = " ".join(f"Word{k}" for k in range(50))
    unspaced = "\n".join("".join(chr(0x4E00 + 97 * k + j) for j in range(60)) for k in range(30))
    line = lambda c: " ".join(f"{c}{k}" for k in range(7))
    bad = {"short": "a few words",
           "repeats": "one two three four five six seven eight nine ten " * 5,
           "symbols": " ".join(f"w{k}###" for k in range(40)),
           "lines": "\n".join([line("l"), line("l"), line("m"), line("m")]),
           "length": " ".join(chr(97 + k) * 30 for k in range(26)),
           "capitals": " ".join(f"ABC{'DEFGHIJKL'[k % 9]}{'MNOPQRS'[k % 7]}" for k in range(60))}
    df = spark.createDataFrame([("good", good, "t"), ("unspaced", unspaced, "t")] + [(k, t, "t") for k, t in bad.items()], "doc_id string, text string, w string")
    failed = {r["doc_id"]: r["f"] for r in df.select("doc_id", quality.cascade(quality.RULES).alias("f")).collect()}
    assert failed == {"good": None, "unspaced": None, **{k: k for k in bad}}
    assert [r["doc_id"] for r in quality.keep_good(df).collect()] == ["good", "unspaced"]


def test_quality_order_never_changes_the_verdict(documents):
    verdict = lambda rules: {r["doc_id"]: r["f"] is None for r in documents.select("doc_id", quality.cascade(rules).alias("f")).collect()}
    assert verdict(quality.RULES) == verdict(quality.RULES[::-1]) == verdict(quality.order_rules(documents))


def test_rules_are_timed_inside_the_row(spark):
    words = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(i, words if i % 4 else "short") for i in range(200)], "doc_id long, text string")
    cheap, dear = quality.Rule("cheap", "size(w) < 20"), quality.Rule("dear", f"{quality.N_REPEAT_WORDS} >= 0 and size(w) < 20")
    found = quality.rule_costs(df, (dear, cheap)).first()
    assert (found["n_0"], found["n_1"]) == (50, 50)  # the same rejections ...
    assert found["cost_0"] > 10 * found["cost_1"] > 0  # ... at a cost that no start of a job levels out
    assert [r.name for r in quality.order_rules(df, (dear, cheap))] == ["cheap", "dear"]
    plan = quality.rule_costs(df, (dear, cheap))._jdf.queryExecution().toString()
    assert "Limit" not in plan and "Python" not in plan


def test_quality_runs_no_python(documents):
    plan = quality.quality_features(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("operator", [lambda d: pieces.encode_decode(d, MODEL), lambda d: pieces.encode_digests(d, MODEL), find_pii, find_secrets,
                                      quality.quality_features, quality.keep_good])
def test_empty_table(empty, operator):
    assert operator(empty).collect() == []


def test_words_are_ascii_space_separated():
    assert words("a\x1cb c d") == ["a\x1cb c", "d"]


def test_very_long_digit_runs_are_no_error():
    from cardlens.llm.pii import anchors, joined, spans
    text = "9" * 5000 + ".1.2.3 and " + "0" * 5000 + "7.1.2.3 and 1.2.3.256"
    assert joined(s for s in spans(text, anchors()) if s[2] == "ip") == f"ip:5011:{5011 + 5007}"
