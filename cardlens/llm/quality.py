"""Quality rules as a short-circuit cascade (operator 6), DataFrame functions only.

A rule is a SQL condition over a text ``t`` and its words ``w``.  On a bounded
random sample the tasks read the clock before and after each rule of each row
(its cost) and count its rejections (its selectivity); rules are then tried in
the order of rejections per second of cost.
The cascade is one CASE whose branches Spark evaluates in turn: a row leaves at
its first failing rule and later rules are never computed for it.  The order
changes what is computed, never the verdict, which is that of all rules.

Everything is an expression inside one row, so there is no shuffle.  Repeated
8-word windows are found by hashing each window; only a text whose hashes are
not all distinct has them sorted with their positions, so a text of n words
costs n log n at most.  Intermediate values are bound with one-element arrays:
a value that is used twice, or inside a lambda, is computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

WINDOW = 8
#: SQL: the clock of the executor in nanoseconds, read for each row.
CLOCK = "reflect('java.lang.System', 'nanoTime')"


def let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def without(text: str, chars: str) -> str:
    return f"char_length(translate({text}, '{chars}', ''))"


TEXT = "coalesce(cast({} as string), '')"
WORDS = r"array_remove(split(t, r'[\x20\x09-\x0D]+'), '')"
LINES = r"filter(split(t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"
WORD_CHARS = without("t", r" \t\n\u000b\f\r".replace(r"\f", r"\u000c"))
N_SYMBOLS = f"char_length(t) - {without('t', '#*$%&|<>')}"
N_UPPER = f"char_length(t) - {without('t', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}"
N_DUP_LINES = let("l", LINES, "size(l) - size(array_distinct(l))")

_HASHES = (f"case when size(w) < {WINDOW} then cast(array() as array<bigint>) "
           f"else transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) end")
_SORTED = "sort_array(transform(h, (x, i) -> struct(x as h, i as i)))"
#: Positions, in order, of the windows whose hash a neighbour in the sorted list shares.
_REPEATED = """sort_array(transform(filter(
  zip_with(zip_with(s, slice(s, 2, size(s)), (a, b) -> struct(a.h as h, a.i as i, b.h as after)),
           concat(array(cast(null as bigint)), transform(slice(s, 1, size(s) - 1), x -> x.h)),
           (a, before) -> struct(a.i as i, a.h <=> a.after or a.h <=> before as twice)),
  x -> x.twice), x -> x.i))"""
_COVERED = f"""{WINDOW} + aggregate(zip_with(slice(p, 2, size(p)), slice(p, 1, size(p) - 1),
  (b, a) -> least(b - a, {WINDOW})), 0, (s, x) -> s + x)"""
N_REPEAT_WORDS = let("h", _HASHES, "case when size(array_distinct(h)) = size(h) then 0 else "
                     + let("s", _SORTED, let("p", _REPEATED, _COVERED)) + " end")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the text ``t`` (never null) and its words ``w``."""
    name: str
    rejects: str


#: The contract's two rules, then the method's own.  Null and empty texts fail ``short``.
BASE = (Rule("short", "size(w) < 20"),
        Rule("repeats", f"100L * {N_REPEAT_WORDS} > 30L * size(w)"))
RULES = (
    *BASE,
    Rule("symbols", f"100L * ({N_SYMBOLS}) > 10L * size(w)"),
    Rule("lines", let("l", LINES, "size(l) >= 4 and 100L * (size(l) - size(array_distinct(l))) > 40L * size(l)")),
    # scripts without blanks between words have long runs of characters of three bytes
    Rule("length", let("c", WORD_CHARS, "c < 2L * size(w) or (c > 20L * size(w) and octet_length(t) < 2L * char_length(t))")),
    Rule("capitals", f"100L * ({N_UPPER}) > 50L * ({WORD_CHARS})"),
)


def over_words(body: str, text_col: str) -> Column:
    """A column of SQL over ``t`` and ``w`` for each text."""
    return F.expr(let("t", TEXT.format(f"`{text_col}`"), let("w", WORDS, body)))


def cascade(rules, text_col: str = "text") -> Column:
    """Name of the first failing rule, null for a text that passes them all."""
    branches = " ".join(f"when {rule.rejects} then '{rule.name}'" for rule in rules)
    return over_words(f"case {branches} end", text_col)


def rule_costs(sample: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """One row: for rule k the nanoseconds ``cost_k`` spent on it over all rows
    of ``sample`` and the rows ``n_k`` that it rejects.

    The clock is read inside the row, between the rules, so neither the start of
    a job nor the scan nor the splitting into words counts to a rule."""
    timed = ", ".join(f"{r.rejects} as r{k}, {CLOCK} as t{k + 1}" for k, r in enumerate(rules))
    rows = sample.select(over_words(f"struct({CLOCK} as t0, {timed})", text_col).alias("x"))
    return rows.agg(*(c for k in range(len(rules)) for c in (
        F.sum(F.col(f"x.t{k + 1}").cast("long") - F.col(f"x.t{k}").cast("long")).alias(f"cost_{k}"),
        F.count_if(F.col(f"x.r{k}")).alias(f"n_{k}"))))


def order_rules(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = 2000) -> list[Rule]:
    """Rules by rejections per second on a random sample of ``sample_rows`` rows
    on average (a documented bound: only the order depends on it).  Each task
    writes what it draws; no task receives the sample.  It is run twice, and the
    first run only warms up the executors.  An empty sample leaves the given order."""
    rows = docs.count()
    tables = Tables(docs.sparkSession, "quality")
    sample = tables.write(docs.select(F.col(f"`{text_col}`").alias("text")).sample(min(1.0, sample_rows / max(rows, 1)), seed=1), "sample")
    for _ in range(2):
        found = rule_costs(sample, rules).first()
    tables.drop("sample")
    if found["cost_0"] is None:
        return list(rules)
    score = {rule.name: found[f"n_{k}"] / max(found[f"cost_{k}"], 1) for k, rule in enumerate(rules)}
    return sorted(rules, key=lambda rule: -score[rule.name])


def quality_features(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed)``.

    ``failed`` names the first failing rule in cascade order, null if none;
    ``kept`` is false if a rule fails.  A null text counts as empty: no words,
    so ``base_failed``.  Null doc_ids and repeated rows are rows of their own;
    extra columns are ignored; an empty table gives no rows."""
    ordered = order_rules(docs, rules, text_col)
    own = " ".join(f"when {r.rejects} then '{r.name}'" for r in ordered if r not in BASE)
    found = f"""struct(cast(size(w) as long) as n_words, cast({WORD_CHARS} as long) as word_chars,
      cast({N_SYMBOLS} as long) as n_symbols, cast({N_DUP_LINES} as long) as n_dup_lines,
      cast({N_REPEAT_WORDS} as long) as n_repeat_words)"""
    base = "q.n_words < 20 or 100L * q.n_repeat_words > 30L * q.n_words"
    body = let("q", found, f"struct(q as q, case when q.n_words < 20 then '{BASE[0].name}' "
                           f"when {base} then '{BASE[1].name}' {own} end as failed, {base} as base_failed)")
    return (docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), over_words(body, text_col).alias("r"))
            .select("doc_id", "r.q.*", "r.base_failed", F.col("r.failed").isNull().alias("kept"), "r.failed"))


def keep_good(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that no rule rejects."""
    return docs.where(cascade(order_rules(docs, rules, text_col), text_col).isNull())
