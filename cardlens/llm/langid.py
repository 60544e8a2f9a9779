"""Language ID by rank-order profiles (operator 11; Cavnar and Trenkle, 1994).

*Grams.*  A text is lower-cased; its words are its runs of letters.  Its grams
are the runs of one to three symbols of each word with a blank on either side,
the lone blank left out.

*Profiles.*  A language's profile is its ``size`` most frequent grams over all
its learning rows, in order of frequency.  Tasks count the grams of their rows
by language, the counts are added up after one shuffle on (language, gram), and
a row-number limit by language, applied before its shuffle too, keeps the most
frequent.  No row is sampled, and a language that holds most rows is many
groups, one for each gram.

*Prediction.*  The same number of a text's most frequent grams are compared
with each profile: a gram costs the difference of its two ranks, and ``size`` if
the profile lacks it.  The nearest profile gives the language, and the score is
1 less the distance's share of the greatest possible one.  Rows are independent:
one pass, no shuffle.  The profiles travel with the tasks, ``LANGUAGES``
languages of ``size`` grams at most a pass; further ones take further passes.

Frequency ties go by the code points of the gram, distance ties to the language
whose name comes first.  Null and empty texts and those without a letter are
``und`` with score 0, as is all if nothing can be learned.  Repeated rows count
as often as they are there.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, frugal

BLANK = 0x20
BITS = 21  # of a code point
SIZE = 400
#: Languages compared in one pass, 16 bytes a gram: 1.6 MB with a task.
LANGUAGES = 256
#: Texts of one block, so that a row's number and three symbols fit in 63 bits.
ROWS = 512
HELD = 1 << 20  # counts that a task holds before it hands them on
COUNTS = "lang string, gram long, n long"
UNKNOWN = "und"


def runs_of_rows(texts: list, limit: int = 1 << 18):
    """(first, last) of consecutive rows with about ``limit`` characters, ``ROWS`` at most; a longer text is a run of its own."""
    first = held = 0
    for at, text in enumerate(texts):
        n = len(text or "")
        if at > first and (held + n > limit or at - first == ROWS):
            yield first, at
            first, held = at, 0
        held += n
    if first < len(texts):
        yield first, len(texts)


class Grams:
    """Counts the grams of a block of texts by owner (a row, or a language)."""

    def __init__(self):
        self.ids = np.zeros(0x110000, np.int64)  # of the block's letters, in code point order; cleared after each block
        self.seen = np.zeros(0x110000, bool)

    def __call__(self, texts: list[str], owners: np.ndarray):
        """``(owner, code, n, alphabet, bits)``, sorted by owner and code.  A
        code has ``bits`` for each symbol, an index of ``alphabet`` (code
        points; 0 is no symbol, 1 the blank)."""
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32)
        self.seen[points] = True
        present = np.flatnonzero(self.seen)
        self.seen[present] = False
        letters = present[[chr(p).isalpha() for p in present]] if len(present) else present
        self.ids[letters] = np.arange(2, len(letters) + 2)
        symbols = self.ids[points]
        self.ids[letters] = 0
        bits = int(len(letters) + 1).bit_length()
        owner = np.repeat(owners.astype(np.int64), [len(t) + 1 for t in lowered])
        owner = np.concatenate([owner[:1], owner])  # of the leading line end, which is a blank
        keep = symbols > 0
        keep[1:] |= keep[:-1].copy()  # the blank after a word
        keep[0] = True
        symbols, owner = symbols[keep], owner[keep]
        letter = symbols > 0
        symbols[~letter] = 1
        one = (owner[letter], symbols[letter])
        two = (np.where(letter[:-1], owner[:-1], owner[1:]), symbols[:-1] << bits | symbols[1:])
        mid = letter[1:-1]
        three = (owner[1:-1][mid], (symbols[:-2] << 2 * bits | symbols[1:-1] << bits | symbols[2:])[mid])
        keys = np.concatenate([o << 3 * bits | c for o, c in (one, two, three)])
        if len(keys) and int(keys.max()) < 1 << 32:
            keys = keys.astype(np.uint32)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        keys = keys[first].astype(np.int64)
        return keys >> 3 * bits, keys & ((1 << 3 * bits) - 1), n, np.concatenate([[0, BLANK], letters]), bits


def to_points(code: np.ndarray, alphabet: np.ndarray, bits: int) -> np.ndarray:
    """Codes of a block as three packed code points each."""
    mask = (1 << bits) - 1
    return (alphabet[code >> 2 * bits] << 2 * BITS | alphabet[code >> bits & mask] << BITS | alphabet[code & mask]).astype(np.int64)


def gram_text(gram: int) -> str:
    """A packed gram as text, blanks written as ``_``."""
    points = [gram >> s & ((1 << BITS) - 1) for s in (2 * BITS, BITS, 0)]
    return "".join("_" if p == BLANK else chr(p) for p in points if p)


def _merged(parts: list) -> list:
    """(language, gram, n) arrays with each pair once."""
    lang, gram, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((gram, lang))
    lang, gram, n = lang[order], gram[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])]))
    return [lang[first], gram[first], np.add.reduceat(n, first)] if len(lang) else [lang, gram, n]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all of ``rows`` (lang, text)."""

    def run(batches):
        count, names, held, size = Grams(), {}, [], 0

        def out():
            known = np.array(list(names), dtype=object)
            lang, gram, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(known[lang], pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in runs_of_rows(texts):
                number = {}  # of the block's languages
                owners = np.array([number.setdefault(x, len(number)) for x in langs[a:b]])
                owner, code, n, alphabet, bits = count(texts[a:b], owners)
                lang = np.array([names.setdefault(x, len(names)) for x in number], np.int64)[owner]
                held.append((lang, to_points(code, alphabet, bits), n))
                size += len(n)
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out()
                        held, size, names = [], 0, {}
        if size:
            held = [_merged(held)]
            yield out()

    counted = rows.select("lang", "text").mapInArrow(frugal(run), COUNTS)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_profiles(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(lang, rank, gram, n): the ``size`` most frequent grams of each language
    of ``rows`` (lang, text), ranks from 0.  Rows without a language or a text
    are left out."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return gram_counts(known).withColumn("rank", rank - 1).where(F.col("rank") < size).select("lang", "rank", "gram", "n")


class Nearest:
    """Distances of a block's texts to the profiles of up to ``LANGUAGES`` languages."""

    def __init__(self, names: list[str], profiles: list[tuple[int, int, int]], size: int):
        self.names, self.size = names, size  # profiles: (index of the language, rank, gram)
        lang, rank, gram = (np.array(c, np.int64) for c in zip(*profiles))
        self.grams, row = np.unique(gram, return_inverse=True)
        self.ranks = np.full((len(self.grams) + 1, len(names)), -1, np.int32)  # the last row: in no profile
        self.ranks[row, lang] = rank
        self.parts = [self.grams >> s & ((1 << BITS) - 1) for s in (2 * BITS, BITS, 0)]
        self.count = Grams()

    def __call__(self, texts: list[str]):
        """(row, language, distance, grams compared) of each text with a letter."""
        owner, code, n, alphabet, bits = self.count(texts, np.arange(len(texts)))
        if not len(n):
            return (np.zeros(0, np.int64),) * 4
        # most frequent first; ties stay in code point order
        top = int(n.max())
        if len(texts) * (top + 1) * len(n) < 1 << 62:
            order = np.sort((owner * (top + 1) + (top - n)) * len(n) + np.arange(len(n))) % len(n)
        else:
            order = np.lexsort((-n, owner))
        first = np.searchsorted(owner, owner)  # owners keep their places in this order
        rank = np.arange(len(n)) - first
        keep = rank < self.size
        owner, code, rank = owner[keep], code[order[keep]], rank[keep].astype(np.int32)
        # the profiles in this block's codes
        at = [np.searchsorted(alphabet[1:], p) + 1 for p in self.parts]
        at = [np.where(p == 0, 0, np.minimum(a, len(alphabet) - 1)) for a, p in zip(at, self.parts)]
        here = np.flatnonzero(np.logical_and.reduce([alphabet[a] == p for a, p in zip(at, self.parts)]))
        codes = (at[0] << 2 * bits | at[1] << bits | at[2])[here]
        by = np.argsort(codes)
        here, codes = here[by], codes[by]
        found = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
        row = np.where(codes[found] == code, here[found], len(self.grams)) if len(codes) else np.full(len(code), len(self.grams))
        theirs = self.ranks[row]
        cost = np.where(theirs < 0, np.int32(self.size), np.abs(theirs - rank[:, None]))
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        far = np.add.reduceat(cost, start, axis=0, dtype=np.int64)
        best = far.argmin(1)
        return owner[start], best, far[np.arange(len(best)), best], np.diff(np.append(start, len(owner)))


def predict_languages(rows: DataFrame, profiles: DataFrame, size: int = SIZE) -> DataFrame:
    """``rows`` with lang_pred, score and distance.  ``rows`` has a column
    ``text``, and none of these three names."""
    names = [r[0] for r in profiles.select("lang").distinct().orderBy("lang").collect()]  # the learned languages alone
    out = rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "distance": F.lit(None).cast("long")})
    for k in range(0, len(names), LANGUAGES):
        block = names[k: k + LANGUAGES]
        number = {name: i for i, name in enumerate(block)}
        found = profiles.where(F.col("lang").isin(block)).select("lang", "rank", "gram").collect()  # LANGUAGES * size rows at most
        out = out.mapInArrow(frugal(_nearer(block, [(number[r[0]], r[1], r[2]) for r in found], size, out.columns)), out.schema)
    return out


def _nearer(names, profiles, size, columns):
    """A batch function that keeps, for each row, the nearest language so far."""
    text_at, *result = (columns.index(c) for c in ("text", "lang_pred", "score", "distance"))

    def run(batches):
        near = Nearest(names, profiles, size)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            pred, score, far = (batch.column(i).to_pylist() for i in result)
            for a, b in runs_of_rows(texts):
                for row, lang, distance, grams in zip(*(x.tolist() for x in near(texts[a:b]))):
                    if far[a + row] is None or distance < far[a + row]:
                        pred[a + row], far[a + row], score[a + row] = names[lang], distance, 1.0 - distance / (size * grams)
            arrays = list(batch.columns)
            for i, made, kind in zip(result, (pred, score, far), (pa.string(), pa.float64(), pa.int64())):
                arrays[i] = pa.array(made, kind)
            yield pa.RecordBatch.from_arrays(arrays, names=list(columns))

    return run


def predict_held_out(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document.

    ``held_out``: crc32 of the doc_id as text (a null one is empty), modulo 3,
    is 1.  The profiles are learned from the other documents' text and lang."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"), (fold == 1).alias("held_out"))
    profiles = Tables(docs.sparkSession, "langid").write(language_profiles(rows.where(~F.col("held_out")), size), "profiles")
    return predict_languages(rows.select("doc_id", "held_out", "text"), profiles, size).select("doc_id", "held_out", "lang_pred", "score")
