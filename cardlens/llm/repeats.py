"""Substring dedup by super-k-mer partitioning (operator 8).

A window is 50 consecutive words of one document.  Its minimiser is the least
hash among its runs of 16 words; consecutive windows that share it form one
super-k-mer, a stretch of text that is sent once, as one packed string, to the
bucket of its minimiser.  Equal windows have equal minimisers, so they always
meet in one bucket, where the windows are cut out, sorted, and equal ones are
neighbours: the comparison is on the words themselves.

* Only minimisers that occur in two documents can hold a repeated window.  The
  minimisers alone are counted first (a row of a few bytes for about 18 words)
  and the other super-k-mers are never packed.
* Equal packed strings are summed to one row, with their smallest doc_id,
  before the bucket; the answer is joined back to the documents.  A passage
  that a third of all documents hold is one row in its bucket.
* The windows of a minimiser with more than ``hot`` windows in its distinct
  super-k-mers (a passage in many different surroundings) are cut again, into super-k-mers by the
  least hash among their runs of 40 words, and what is still crowded by the hash of the
  window (``LEVELS``), so no bucket grows with the passage.  The inside of the passage
  travels as a few long pieces, equal in all documents; only windows at its edges
  travel one by one.
* Copies of a piece within one document are one row with all their places, so
  a text that repeats a few words for long does not send each of its windows.
* Buckets are read as a sorted stream; a task holds one bucket at a time.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, WordHasher, frugal, id_and_text, mix, text_blocks, windows

WINDOW = 50
#: Words of the runs that minimisers are taken from, by level; the last is the window itself.
LEVELS = (16, 40, WINDOW)
#: Longest super-k-mer, in windows; a longer run of one minimiser is cut.
LONGEST = 2048
PACK = 4096  # rows of a batch that a task emits


def _runs(words: np.ndarray, bounds: np.ndarray, level: int = 0, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(owner, minimiser, first window, windows, mark) of each super-k-mer, of
    windows that start at a ``wanted`` word only, if given; the mark is a sum over
    its words, so equal super-k-mers have one mark."""
    n = len(words) - WINDOW + 1
    counts = np.diff(bounds)
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    owner = np.repeat(np.arange(len(counts)), counts)
    low = windows(words, LEVELS[level], 1 + level)
    span, have = WINDOW - LEVELS[level] + 1, 1
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    inside = owner[:n] == owner[WINDOW - 1:]
    at = np.flatnonzero(inside if wanted is None else inside & wanted[:n])
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    value, who = low[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(at)))
    parts = -(-sizes // LONGEST)
    heads = np.repeat(heads, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    sizes = np.minimum(np.diff(np.append(heads, len(at))), LONGEST)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words), out=sums[1:])
    marks = sums[at[heads] + sizes + WINDOW - 1] - sums[at[heads]]
    return who[heads], value[heads], at[heads] - bounds[who[heads]], sizes, marks


def _wanted(spans: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Which words start a window of the ``spans`` (starts, n) of their text."""
    starts, n = spans.flatten().flatten()
    copies = pc.list_value_length(starts).to_numpy(zero_copy_only=False)
    n = np.repeat(n.to_numpy(zero_copy_only=False), copies)
    first = np.repeat(np.repeat(bounds[:-1], pc.list_value_length(spans).to_numpy(zero_copy_only=False)), copies)
    start = first + starts.flatten().to_numpy(zero_copy_only=False)
    change = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + n, -1)
    return np.cumsum(change)[:-1] > 0


def super_kmers(level: int):
    """(doc_id, th, text) -> (doc_id, th, mini, n, mark, starts): super-k-mers by
    place; beyond the first level (doc_id, th, text, spans), those of the spans.
    Those of one document with one minimiser, length and mark are one row."""

    def cut(batches):
        hasher = WordHasher()
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_blocks(batch.column(2)):
                words, bounds, _, _ = hasher(data, offsets)
                wanted = _wanted(batch.column(3).slice(first, len(offsets) - 1), bounds) if level else None
                owner, value, start, n, mark = _runs(words, bounds, level, wanted)
                order = np.lexsort((mark, value, owner))
                new = np.ones(len(order), bool)
                new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (owner, value, mark, n)], axis=0)
                heads = np.flatnonzero(new)
                one = order[heads]
                starts = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)), pa.int32()), pa.array(start[order], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + owner[one]], pa.int64()), pa.array(marks[first + owner[one]], pa.int64()),
                     pa.array(value[one].view(np.int64)), pa.array(n[one], pa.int64()), pa.array(mark[one].view(np.int64)), starts],
                    names=["doc_id", "th", "mini", "n", "mark", "starts"])

    return cut


def pack(batches):
    """(doc_id, th, text, spans) -> (bucket, piece, doc_id, th, at): the named
    super-k-mers as strings of words joined by one space, with their places in the document."""
    slices = (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256))
    for batch in slices:
        rows = []
        for doc_id, th, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.encode().split()
            for s in spans:
                found = {}
                for start in s["starts"]:
                    found.setdefault(b" ".join(words[start: start + s["n"] + WINDOW - 1]), []).append(start)
                rows += [(s["mini"], piece.decode(), doc_id, th, at) for piece, at in found.items()]
                if len(rows) >= PACK:
                    yield _packed(rows)
                    rows = []
        if rows:
            yield _packed(rows)


def _packed(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["bucket", "piece", "doc_id", "th", "at"])


def count_windows(batches):
    """Sorted (bucket, piece, lo, hi) -> (bucket, piece, firsts): for each
    window of the piece the smallest doc_id that holds it.  Pieces whose
    documents are all the first of every window are left out."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    out = []
    for bucket, group in groupby(rows(), key=lambda r: r[0]):
        group = list(group)
        if len(group) == 1 and group[0][2] == group[0][3]:
            continue
        entries = []
        for k, (_, piece, lo, _) in enumerate(group):
            at = [0, *(m.end() for m in re.finditer(" ", piece)), len(piece) + 1]
            entries += [(piece[at[i]: at[i + WINDOW] - 1], lo, k, i) for i in range(len(at) - WINDOW)]
        entries.sort()
        firsts = [{} for _ in group]
        seen, first = None, None
        for window, lo, k, i in entries:  # equal windows are neighbours, the smallest doc_id first
            if window != seen:
                seen, first = window, lo
            firsts[k][i] = first
        for (_, piece, _, hi), found in zip(group, firsts):
            if any(f < hi for f in found.values()):
                out.append((bucket, piece, [found[i] for i in range(len(found))]))
        if len(out) >= PACK:
            yield _answers(out)
            out = []
    if out:
        yield _answers(out)


def _answers(out: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["bucket", "piece", "firsts"])


def cut_out(batches):
    """(doc_id, text, starts) -> (doc_id, n_words, n_removed, kept): the text
    without the words that windows at ``starts`` cover."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            counts, removed, kept = [], [], []
            for text, starts in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                words = (text or "").encode().split()
                counts.append(len(words))
                if starts:
                    change = np.zeros(len(words) + 1, np.int64)
                    starts = np.unique(np.asarray(starts, np.int64))
                    change[starts] += 1
                    change[starts + WINDOW] -= 1
                    words = [w for w, cover in zip(words, np.cumsum(change)) if not cover]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 8192) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for each row of ``docs``: the text
    without words covered by a 50-word window that also starts in a document
    with a smaller doc_id; kept words are joined by one space.

    Windows are judged on the input.  Texts that are null, empty or under 50
    words have no window and stay.  A row whose doc_id is null has no smaller
    and is smaller than none: it stays whole.  Rows that share a doc_id are one
    document with several texts, so repeats among them stay.  Extra columns are
    ignored; an empty table gives no rows.  ``hot`` only steers how a frequent
    minimiser travels, not the result."""
    tables = Tables(docs.sparkSession, "repeats")
    base = id_and_text(docs, id_col, text_col)
    named = base.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    places, asked, used = None, named, []
    for level in range(len(LEVELS)):
        used += [f"kmers{level}", f"held{level}", f"shared{level}"]
        kmers = tables.write(asked.mapInArrow(frugal(super_kmers(level)), "doc_id long, th long, mini long, n long, mark long, starts array<long>"), used[-3])
        held = tables.write(kmers.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("c"))
                            .where("lo < hi").select("mini", "c"), used[-2])
        # copies of one super-k-mer are one row of its bucket: those with many windows are counted again by mark
        limit = hot if LEVELS[level] < WINDOW else (1 << 63) - 1
        crowded = (kmers.join(held.where(F.col("c") > limit), "mini").groupBy("mini", "mark").agg(F.max("n").alias("n"))
                   .groupBy("mini").agg(F.sum("n").alias("c")).where(F.col("c") > limit).select("mini", F.lit(True).alias("hot")))
        shared = tables.write(held.join(crowded, "mini", "left").select("mini", F.coalesce("hot", F.lit(False)).alias("hot")), used[-1])
        found = kmers.join(shared, "mini")
        cold = found.where("not hot").select("doc_id", "th", "starts", "n", "mini")
        places = places.unionByName(cold) if places is not None else cold
        if shared.where("hot").isEmpty():
            break
        again = found.where("hot").groupBy("doc_id", "th").agg(F.collect_set(F.struct("starts", "n")).alias("spans"))
        asked = named.join(again, ["doc_id", "th"]).select("doc_id", "th", "text", "spans")
    spans = places.groupBy("doc_id", "th").agg(F.collect_set(F.struct("starts", "n", "mini")).alias("spans"))
    pieces = tables.write(named.join(spans, ["doc_id", "th"]).select("doc_id", "th", "text", "spans").mapInArrow(
        frugal(pack), "bucket long, piece string, doc_id long, th long, at array<long>"), "pieces")
    tables.drop(*used)
    distinct = pieces.groupBy("bucket", "piece").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    answers = tables.write(distinct.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(
        frugal(count_windows), "bucket long, piece string, firsts array<long>"), "answers")
    starts = F.expr("flatten(transform(at, s -> transform(filter(sequence(0, size(firsts) - 1), i -> firsts[i] < doc_id), i -> s + i)))")
    covered = (pieces.join(answers, ["bucket", "piece"]).select("doc_id", "th", starts.alias("starts")).where("size(starts) > 0")
               .groupBy("doc_id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    covered = tables.write(covered, "covered")
    tables.drop("pieces", "answers")
    joined = named.join(covered, ["doc_id", "th"], "left").select("doc_id", "text", "starts")
    plain = base.where("doc_id is null or text is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("starts"))
    return joined.unionByName(plain).mapInArrow(frugal(cut_out), "doc_id long, n_words long, n_removed long, kept string")
