"""Spelling variant grouping by k-d trees over letter-count vectors (operator 13).

One edit changes a word's letter counts by at most two: a replacement takes one
from one letter and adds one to another, an insertion adds one to one letter.
So near words are found by range searches among letter-count vectors, between
words of one length and between words of lengths L and L + 1, and the letter
order of what is found is then verified.

*Cells.*  Words go to cells: the leaves of a k-d tree over the counts of their
length, which is split at the most even count of a letter until a cell holds
about ``CELL`` words.  These upper trees are fitted on at most ``SAMPLE`` words,
taken by hash, and only deal out the work: every word is placed and asked for,
and results do not depend on them.  A cell that stays large, because its words
have one vector, is cut into slices by hash.
*Searches.*  A word asks the cells of its own length and of the next whose boxes
it can reach with one letter more and one less, or with one letter missing.
*Groups.*  One slice of a cell with one share of its askers is a task's group.  It
builds a tree over the slice, with the bounds of the words in each branch as
boxes, takes all askers down it at once, compares counts at the leaves in one
matrix product and verifies the order of the letters of what is left.

Tasks hand on one row for each word with near words, their number and the best of
them, never pairs.  Counting is partial before its shuffle, so a word that holds a
third of all runs is one row a task.  Cells are bounded in bytes too, so that very
long words are a few to a cell.

Null and empty texts have no words; a null doc_id is empty in the hash.  Repeated
rows count as often as they are there.  An empty table gives no rows, and other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, frugal

RUN = "[A-Za-zÀ-ÿ]"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Letters of a run, in Latin-1, as dimensions; all others share the last one (there are none in a run).
DIMS = 91
DIMENSION = np.full(256, DIMS - 1, np.uint8)
DIMENSION[97:123] = np.arange(26)
DIMENSION[0xC0:0x100] = np.arange(26, 90)

CELL = 8192  # words of a cell, and half the askers of a group
CELL_BYTES = 8 << 20
SAMPLE = 200_000
CELLS = 16_384  # of all lengths together, so that the upper trees are a few MB with a task
LEAF = 96
HELD = 200_000  # distinct words that a task counts before it hands them on
COUNTED = "word binary, n long"
FOUND = "word binary, n_near long, form_n long, form binary"
SURPLUS, DEFICIT = (1, 0), (1, 1)  # how far above and below a box a query may lie: (same length, one letter shorter)


def _latin(words) -> pa.Array:
    return pa.array(words, pa.binary())


def word_counts(docs: DataFrame, min_length: int = 7, drop_every: int = 31) -> DataFrame:
    """(word, n) of all runs of letters with at least ``min_length`` letters,
    A-Z lowered, as Latin-1.  Where crc32 of ``<doc_id>:<run>`` is a multiple of
    ``drop_every``, the letter at that hash modulo the run's length is dropped first."""
    pattern = re.compile(f"{RUN}{{{max(1, min_length)},}}")

    def run(batches):
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([_latin(list(total)), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seed = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
                for found, n in Counter(pattern.findall(text.as_py() or "")).items():
                    word = found.encode("latin-1").translate(LOWER)
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if drop_every and not h % drop_every:
                        k = h % len(word)
                        word = word[:k] + word[k + 1:]
                        if len(word) < min_length:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield out()
                    total.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(frugal(run), COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


def letters(column: pa.Array) -> np.ndarray:
    """(words, length) Latin-1 codes of a binary column whose words have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), np.uint8)
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]: at[-1]].reshape(len(column), -1)


def letter_counts(codes: np.ndarray, dimension: np.ndarray = DIMENSION, dims: int = DIMS) -> np.ndarray:
    n, length = codes.shape
    at = np.arange(n, dtype=np.int64)[:, None] * dims + dimension[codes]
    return np.bincount(at.ravel(), minlength=n * dims).reshape(n, dims).astype(np.int16 if length < 1 << 15 else np.int32)


class Tree:
    """A k-d tree over count vectors.  Nodes are arrays; ``rows[leaf]`` are the
    vectors of a leaf.  A node is split at the most even count of a letter until
    it holds at most ``leaf`` vectors or all are equal."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.split: list = []  # (dimension, greatest count on the left, left, right), or None for a leaf
        self.box: list = []  # least and greatest counts of the node's vectors
        self.rows: dict[int, np.ndarray] = {}
        waiting = [(self._node(), np.arange(len(counts)))]
        while waiting:
            node, rows = waiting.pop()
            own = counts[rows]
            self.box[node] = (own.min(0), own.max(0)) if len(rows) else (counts[:0].sum(0), counts[:0].sum(0))
            cut = self._cut(own) if len(rows) > leaf else None
            if cut is None:
                self.rows[node] = rows
                continue
            left = own[:, cut[0]] <= cut[1]
            self.split[node] = (*cut, self._node(), self._node())
            waiting += [(self.split[node][2], rows[left]), (self.split[node][3], rows[~left])]

    def _node(self) -> int:
        self.split.append(None)
        self.box.append(None)
        return len(self.split) - 1

    @staticmethod
    def _cut(own: np.ndarray):
        """(dimension, count) of the most even split, or None if all vectors are equal."""
        n, (low, high) = len(own), (own.min(0), own.max(0))
        middle = np.partition(own, n // 2, axis=0)[n // 2]
        best = (0, None)
        for bound in (middle, middle - 1):
            bound = np.clip(bound, low, np.maximum(high - 1, low))
            left = (own <= bound).sum(0)
            even = np.where(high > low, np.minimum(left, n - left), 0)
            d = int(even.argmax())
            if even[d] > best[0]:
                best = (int(even[d]), (d, int(bound[d])))
        return best[1]

    def open(self) -> "Tree":
        """The tree without its vectors, its boxes those of the splits alone, so
        that they hold every vector: leaves part the whole space."""
        dims = len(self.box[0][0])
        self.box[0] = (np.zeros(dims, np.int32), np.full(dims, np.iinfo(np.int32).max, np.int32))
        for node, cut in enumerate(self.split):  # parents come before their children
            if cut:
                (low, high), (d, count, left, right) = self.box[node], cut
                below, above = high.copy(), low.copy()
                below[d], above[d] = count, count + 1
                self.box[left], self.box[right] = (low, below), (above, high)
        self.rows = {leaf: None for leaf in self.rows}
        return self

    def reach(self, counts: np.ndarray, over: int, under: int):
        """(leaf, queries): the queries with at most ``over`` letters above and
        ``under`` below each leaf's box."""
        waiting = [(0, np.arange(len(counts)))]
        while waiting:
            node, asked = waiting.pop()
            low, high = self.box[node]
            own = counts[asked]
            fits = np.maximum(own - high, 0).sum(1) <= over
            fits &= np.maximum(low - own, 0).sum(1) <= under
            asked = asked[fits]
            if not len(asked):
                continue
            if self.split[node] is None:
                yield node, asked
            else:
                waiting += [(child, asked) for child in self.split[node][2:]]


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced (equal lengths) or one inserted code."""
    length = short.shape[1]
    if long.shape[1] == length:
        return (short != long).sum(1) == 1
    apart = short != long[:, :length]
    first = np.where(apart.any(1), apart.argmax(1), length)
    later = short != long[:, 1:]
    return ~(later & (np.arange(length) >= first[:, None])).any(1)


def _best(who: np.ndarray, whom: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` words the number of pairs and the least rank of its partners."""
    best = np.full(n, len(rank), np.int64)
    np.minimum.at(best, who, rank[whom])
    return np.bincount(who, minlength=n), best


def near_words(words: np.ndarray, askers: np.ndarray):
    """(askers, words) index pairs that differ by one edit, in parts.  Askers are as long as the words or one letter shorter."""
    kind = np.float32 if words.shape[1] < 2000 else np.float64  # squared norms stay whole numbers
    # the letters that occur in the words, and one dimension for all others
    used = np.unique(words)
    dimension = np.full(256, len(used), np.uint8)
    dimension[used] = np.arange(len(used))
    own, theirs = (letter_counts(x, dimension, len(used) + 1) for x in (words, askers))
    shorter = int(words.shape[1] > askers.shape[1])
    target = 1 if shorter else 2
    tree = Tree(own, LEAF)
    # squared distance as one product: [-2 a, 1, a.a] . [q, q.q, 1]
    left, right = own.astype(kind), theirs.astype(kind)
    left = np.hstack([-2 * left, np.ones((len(left), 1), kind), (left * left).sum(1, keepdims=True)])
    right = np.hstack([right, (right * right).sum(1, keepdims=True), np.ones((len(right), 1), kind)])
    for leaf, asked in tree.reach(theirs, SURPLUS[shorter], DEFICIT[shorter]):
        rows = tree.rows[leaf]
        for k in range(0, len(asked), 1 << 14):
            part = asked[k: k + (1 << 14)]
            q, w = np.nonzero(right[part] @ left[rows].T == target)
            q, w = part[q], rows[w]
            fits = one_edit(askers[q], words[w])
            yield q[fits], w[fits]


def _search(words: pa.Table, askers: pa.Table) -> pa.Table:
    """One group: the near words, among a slice of a cell, of a share of its askers."""
    schema = pa.schema([("word", pa.binary()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.binary())])
    parts = []
    if words.num_rows and askers.num_rows:
        own, own_n = letters(words.column("word")), words.column("n").to_numpy()
        length = own.shape[1]
        sizes = askers.column("length").to_numpy()
        for size in (length, length - 1):
            asked = askers.filter(pa.array(sizes == size))
            if not asked.num_rows:
                continue
            theirs, their_n = letters(asked.column("word")), asked.column("n").to_numpy()
            pairs = list(near_words(own, theirs))
            q, w = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            # words of one length ask each other; of two lengths only the shorter asks, so both sides are told
            sides = [(q, w, asked, own_n, words)] + ([(w, q, words, their_n, asked)] if size < length else [])
            for who, whom, table, n, partners in sides:
                order = np.lexsort((partners.column("word").to_numpy(zero_copy_only=False), -n))  # most frequent first, then code points
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                count, best = _best(who, whom, rank, table.num_rows)
                met = np.flatnonzero(count)
                at = order[best[met]]
                parts.append(pa.Table.from_arrays([table.column("word").take(pa.array(met)), pa.array(count[met]), pa.array(n[at]),
                                                   partners.column("word").take(pa.array(at))], schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


def _cell_words(length: int) -> int:
    return max(1, min(CELL, CELL_BYTES // max(1, length)))


def upper_trees(words: DataFrame) -> tuple[dict[int, Tree], dict[tuple[int, int], int]]:
    """Trees of the lengths with more words than a cell, and the shares of
    askers of the (length, cell) that need more than one."""
    sizes = {r[0]: r[1] for r in words.groupBy("length").count().where(F.col("count") > F.greatest(
        F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / F.col("length")))) / 2).collect()}  # a row for each half cell at most
    large = {length: n for length, n in sizes.items() if n > _cell_words(length)}
    total = sum(large.values())
    wanted = {length: n / _cell_words(length) for length, n in large.items()}
    spare = min(1.0, CELLS / max(1.0, sum(wanted.values())))
    trees, sample = {}, {}
    if large:
        rate = min(1.0, SAMPLE / total, (64 << 20) / sum(n * length for length, n in large.items()))
        drawn = words.where(F.col("length").isin(list(large)) & (F.pmod(F.xxhash64("word", F.lit(3)), F.lit(1 << 30)) < int(rate * (1 << 30))))
        for word, length in drawn.select("word", "length").limit(2 * SAMPLE).collect():
            sample.setdefault(length, []).append(bytes(word))
    for length, drawn in sample.items():
        counts = letter_counts(np.frombuffer(b"".join(drawn), np.uint8).reshape(len(drawn), length))
        trees[length] = Tree(counts, max(1, int(len(drawn) / max(1.0, wanted[length] * spare)))).open()
        sample[length] = counts
    shares: Counter = Counter()
    for length, n in sizes.items():
        for of, over, under in ((length, SURPLUS[0], DEFICIT[0]), (length + 1, SURPLUS[1], DEFICIT[1])):
            if of not in trees or length not in sample:
                # the askers of all cells of a length may come to each of them
                for cell in trees[of].rows if of in trees else (0,):
                    shares[of, cell] += n
            else:
                scale = n / len(sample[length])
                for cell, asked in trees[of].reach(sample[length], over, under):
                    shares[of, cell] += len(asked) * scale
    return trees, {key: int(-(-n // (2 * _cell_words(key[0])))) for key, n in shares.items() if n > 2 * _cell_words(key[0])}


def _by_length(batch):
    """(length, row numbers, codes) of the words of a batch."""
    words = batch.column(0)
    sizes = batch.column(2).to_numpy()
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        yield int(length), rows, letters(words.take(pa.array(rows)))


def _place(trees: dict[int, Tree]):
    """(word, n, length) -> the same with the word's cell."""

    def run(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for length, rows, codes in _by_length(batch):
                if length in trees:
                    for leaf, own in trees[length].reach(letter_counts(codes), 0, 0):
                        cell[rows[own]] = leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["word", "n", "length", "cell"])

    return run


def _ask(trees: dict[int, Tree]):
    """(word, n, length) -> a row for each cell, of lengths ``of``, that the word asks."""

    def run(batches):
        for batch in batches:
            asks = []
            for length, rows, codes in _by_length(batch):
                counts = letter_counts(codes) if length in trees or length + 1 in trees else None
                for shorter, of in enumerate((length, length + 1)):
                    if of in trees:
                        asks += [(rows[q], of, leaf) for leaf, q in trees[of].reach(counts, SURPLUS[shorter], DEFICIT[shorter])]
                    else:
                        asks.append((rows, of, 0))
            for k in range(0, len(asks), 64):
                part = asks[k: k + 64]
                rows = pa.array(np.concatenate([a[0] for a in part]))
                counts = [len(a[0]) for a in part]
                of, cell = (pa.array(np.repeat([a[i] for a in part], counts).astype(np.int32)) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], of, cell], names=["word", "n", "length", "of", "cell"])

    return run


def near_word_facts(words: DataFrame, tables: Tables) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n, length) that have near
    words: how many, and the one of largest n (ties: the smallest)."""
    trees, shares = upper_trees(words)
    placed = tables.write(words.mapInArrow(frugal(_place(trees)), "word binary, n long, length int, cell int"), "placed")
    # cells that stayed large: their words have one vector, or the sample missed them
    room = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / F.col("length"))))
    slices = tables.write(placed.groupBy("length", "cell").count().where(F.col("count") > 2 * room).select(
        F.col("length").alias("of"), "cell", F.ceil(F.col("count") / room).cast("int").alias("slices")), "slices")
    dealt = words.sparkSession.createDataFrame([(*key, n) for key, n in shares.items()], "of int, cell int, shares int")
    one = F.lit(1)
    have = (placed.withColumnRenamed("length", "of").join(slices, ["of", "cell"], "left").join(dealt, ["of", "cell"], "left")
            .withColumn("slice", F.pmod(F.xxhash64("word", F.lit(5)), F.coalesce("slices", one)).cast("int"))
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", one) - 1))))
    ask = (words.mapInArrow(frugal(_ask(trees)), "word binary, n long, length int, of int, cell int")
           .join(slices, ["of", "cell"], "left").join(dealt, ["of", "cell"], "left")
           .withColumn("share", F.pmod(F.xxhash64("word", F.lit(7)), F.coalesce("shares", one)).cast("int"))
           .withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", one) - 1))))
    keys = ["of", "cell", "slice", "share"]
    found = have.select(*keys, "word", "n").groupBy(*keys).cogroup(ask.select(*keys, "word", "n", "length").groupBy(*keys)).applyInArrow(_search, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def _roots(links: DataFrame, tables: Tables) -> DataFrame:
    """(word, root): the end of the chain of forms, by pointer doubling.  A form
    has ten times its word's n or more, so chains have fewer than 20 links and
    five rounds follow them all."""
    roots = links.select("word", F.col("form").alias("root"))
    for k in range(5):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = tables.write(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        if roots.where("moved").isEmpty():
            break
    return roots.select("word", "root")


def spelling_groups(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, drop_every: int = 31) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of each word of at least
    ``min_length`` letters and ``min_count`` occurrences.  ``form`` is its near
    word of largest n, if that is at least ``ratio`` times its own; ``root`` the
    end of the chain of forms."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2: chains of forms would not end")
    tables = Tables(docs.sparkSession, "spelling")
    counted = word_counts(docs, min_length, drop_every).where(F.col("n") >= min_count)
    words = tables.write(counted.withColumn("length", F.octet_length("word")), "words")
    facts = words.join(near_word_facts(words, tables), "word", "left")
    own = F.col("form_n") >= ratio * F.col("n")
    forms = tables.write(facts.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(own, F.col("form")).alias("form"),
                                      F.when(own, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(forms.where("form IS NOT NULL"), tables)
    text = lambda c: F.decode(c, "ISO-8859-1")
    return forms.join(roots, "word", "left").select(
        text(F.col("word")).alias("word"), "n", text(F.col("form")).alias("form"), "form_n", "n_near",
        text(F.coalesce("root", "word")).alias("root"))
