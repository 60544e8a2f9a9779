"""N-gram Jaccard join (operator 1).

Documents are rows and word shingles columns of a 0/1 incidence matrix ``A``.
Two documents link when the entry of ``A A^T`` (their overlap) reaches 80 % of
their union.  Only a small part of the product can reach that, so the matrix is
cut down before it is multiplied, each time by a bound that loses no link:

1. *Equal rows* are one class (128-bit sum over the set), whatever their ids
   are and however often one occurs.  The class, not an id, is the row from here
   on; the text of its smallest doc_id gives its columns.
2. *Columns held by one class* add to no product.  A class with more than
   ``n - ceil(0.8 n)`` such shingles has no partner.  A fixed 5/16 of the hash
   space is counted first, over all documents; that alone removes most.
3. The remaining classes are counted over all their columns, and bound 1 is
   applied again.
4. *Prefix bound*: with columns ordered by (documents that hold it, hash), two
   linked rows share a column among their first ``n - ceil(0.8 n) + 1``.  The
   connected components of rows over shared prefix columns are the diagonal
   blocks of the product: no link crosses them.

A block of at most ``block_tokens`` entries is multiplied in one task, many
small blocks to a task; a larger one is cut into parts and pairs of parts are
tasks (``_multiply``).  Inside a task the product is sparse: a row's overlaps are
accumulated over the postings of its columns, against the rows that are not yet
known to be connected, or against all rows if links are counted; pairs that
their sizes alone rule out go first.  Each row of a
component leaves the task once, with its number of links, never as pairs.

Words and shingles are compared by 64-bit hashes.  A false link needs two
different shingles of one hash in the very pair whose overlap they carry over
the bound; over all pairs of two texts of n shingles that is under n**2 / 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, WordHasher, broadcast_if_small, frugal, id_and_text, mix, text_blocks, windows
from .components import connected_components

SHINGLE = 5
#: Shingles whose hash lies in this part of the space are counted first.
SAMPLE = 5 << 60
#: Least overlap of a set of n with any partner.
NEED = "(n * 80 + 99) div 100"


def shingle_sets(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: text i has the distinct shingles
    ``hashes[bounds[i]:bounds[i + 1]]``, sorted.  A text of one to four words
    has its whole sequence as one shingle, one without words has none."""
    words, bounds, _, _ = hasher(data, offsets)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    found, owners = [], []
    whole = windows(words, SHINGLE)
    inside = owner[: len(whole)] == owner[SHINGLE - 1:] if len(whole) else np.zeros(0, bool)
    found.append(whole[inside])
    owners.append(owner[: len(whole)][inside])
    for size in range(1, SHINGLE):
        short = np.flatnonzero(counts == size)
        if len(short):
            at = bounds[short]
            total = np.full(len(short), size, np.uint64)
            for j in range(size):
                total = total * np.uint64(0x2545F4914F6CDD1D) + words[at + j]
            found.append(mix(total))
            owners.append(short)
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((found, owners))
    found, owners = found[order], owners[order]
    if len(found):
        first = np.ones(len(found), bool)
        first[1:] = (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])
        found, owners = found[first], owners[first]
    return found, np.searchsorted(owners, np.arange(len(counts) + 1))


def _set_sums(found: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    sums = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(mix(found ^ np.uint64(seed)), out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def measure(batches):
    """(doc_id, text, th) -> (doc_id, th, n, s1, s2, sample): set size, 128-bit
    sum of the set, and the shingles in the part of the hash space counted first."""
    hasher = WordHasher(lower=True)
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column(1)):
            found, bounds = shingle_sets(hasher, data, offsets)
            taken = found < np.uint64(SAMPLE)
            cut = np.concatenate(([0], np.cumsum(taken)))[bounds]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, len(offsets) - 1), batch.column(2).slice(first, len(offsets) - 1),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array(_set_sums(found, bounds, 0x5851F42D4C957F2D).view(np.int64)),
                pa.array(_set_sums(found, bounds, 0x14057B7EF767814F).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(found[taken].view(np.int64)))],
                names=["doc_id", "th", "n", "s1", "s2", "sample"])


def all_shingles(batches):
    """(s1, text) -> (node, n, tokens), every distinct shingle of the texts
    whose set sum is the given s1, which is the node."""
    hasher = WordHasher(lower=True)
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column(1)):
            found, bounds = shingle_sets(hasher, data, offsets)
            rows = batch.slice(first, len(offsets) - 1)
            sums = pa.array(_set_sums(found, bounds, 0x5851F42D4C957F2D).view(np.int64))
            every = pa.RecordBatch.from_arrays([
                sums, pa.array(np.diff(bounds), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found.view(np.int64)))],
                names=["node", "n", "tokens"])
            yield every.filter(pc.equal(sums, rows.column(0)))


class Postings:
    """The entries of some rows of one block by column: the transposed matrix.

    ``overlaps(i)`` is row i of the product, accumulated over the postings of
    its columns only, so entries in columns that no other row holds cost nothing."""

    def __init__(self, columns: np.ndarray, bounds: np.ndarray, rows: np.ndarray):
        self.columns, self.bounds = columns, bounds
        sizes = bounds[rows + 1] - bounds[rows]
        ends = np.cumsum(sizes)
        held = columns[_ranges(bounds[rows], sizes, ends)]
        order = np.argsort(held, kind="stable")
        self.rows = np.repeat(rows, sizes)[order]
        width = int(columns.max()) + 1 if len(columns) else 0
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(held, minlength=width))))

    def overlaps(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that share a column with row i, and how many each."""
        mine = self.columns[self.bounds[i]: self.bounds[i + 1]]
        sizes = self.starts[mine + 1] - self.starts[mine]
        ends = np.cumsum(sizes)
        counts = np.bincount(self.rows[_ranges(self.starts[mine], sizes, ends)])
        rows = np.flatnonzero(counts)
        return rows, counts[rows]


def _ranges(starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places ``starts[k] ... starts[k] + sizes[k] - 1`` of each k in turn."""
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _linked_rows(postings: Postings, sizes: np.ndarray, side: np.ndarray, i: int) -> np.ndarray:
    """Rows, i itself left out, whose overlap with row i reaches 80 % of the union."""
    rows, overlap = postings.overlaps(i)
    n = sizes[rows]
    fit = (n * 100 >= sizes[i] * 80) & (sizes[i] * 100 >= n * 80) & (rows != i)
    if side[i] < 2:
        fit &= side[rows] != side[i]
    rows, overlap, n = rows[fit], overlap[fit], n[fit]
    return rows[overlap * 100 >= (n + sizes[i] - overlap) * 80]


def _stars(part: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Each row of a part with the smallest id of the part."""
    order = np.argsort(part, kind="stable")
    links = []
    for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(group) > 1:
            center = int(ids[group].min())
            links.extend((center, int(i)) for i in ids[group] if i != center)
    return links


def block_links(ids: np.ndarray, side: np.ndarray, columns: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Components of the links among the rows of one block, as stars: each row
    of a component with its smallest id.

    A row is taken from the queue and its overlaps are accumulated over its
    columns; rows that reach 80 % join the queue.  The postings are made anew
    whenever half of their rows have been reached: a pair of reached rows could
    only connect what is connected.  ``side`` 0 and 1 are the two row ranges of
    an off-diagonal tile, whose own pairs other tiles hold; 2 meets every row."""
    sizes = np.diff(bounds)
    _, columns = np.unique(columns, return_inverse=True)
    left = np.ones(len(ids), bool)
    part = np.arange(len(ids))
    postings, live, posted = Postings(columns, bounds, np.arange(len(ids))), len(ids), len(ids)
    for first in range(len(ids)):
        queue = [first] if left[first] else []
        live -= len(queue)
        left[first] = False
        while queue and live:
            rows = _linked_rows(postings, sizes, side, queue.pop())
            rows = rows[left[rows]]
            left[rows] = False
            part[rows] = first
            queue.extend(rows.tolist())
            live -= len(rows)
            if 2 * live < posted:
                postings, posted = Postings(columns, bounds, np.flatnonzero(left)), live
    return _stars(part, ids)


def counted_links(ids: np.ndarray, side: np.ndarray, columns: np.ndarray, bounds: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """As ``block_links``, and the number of links of each row: the whole rows
    of the product are accumulated."""
    sizes = np.diff(bounds)
    _, columns = np.unique(columns, return_inverse=True)
    postings = Postings(columns, bounds, np.arange(len(ids)))
    degree, part = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i in range(len(ids)):
        rows = _linked_rows(postings, sizes, side, i)
        degree[i] = len(rows)
        if len(rows):
            joined = np.unique(part[np.append(rows, i)])
            if len(joined) > 1:
                part[np.isin(part, joined)] = joined[0]
    return _stars(part, ids), degree


def _tile_links(table: pa.Table, count: bool) -> pa.Table:
    """One task's tile: rows (tile, label, side, node, tokens) -> links (a, b,
    null) and, if they are counted, (a, null, number of links of a)."""
    tokens = table.column("tokens").combine_chunks()
    bounds = tokens.offsets.to_numpy().astype(np.int64)
    columns = tokens.values.to_numpy()
    labels, ids, sides = (table.column(c).to_numpy() for c in ("label", "node", "side"))
    order = np.argsort(labels, kind="stable")
    out = []
    for rows in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        if len(rows) > 1:
            n = bounds[rows + 1] - bounds[rows]
            ends = np.cumsum(n)
            block = ids[rows], sides[rows], columns[_ranges(bounds[rows], n, ends)], np.concatenate(([0], ends))
            links, degree = counted_links(*block) if count else (block_links(*block), [])
            out += [(a, b, None) for a, b in links] + [(int(i), None, int(d)) for i, d in zip(block[0], degree) if d]
    return pa.table({name: pa.array([x[k] for x in out], pa.int64()) for k, name in enumerate("abn")})


def tile_links(table: pa.Table) -> pa.Table:
    return _tile_links(table, False)


def tile_links_counted(table: pa.Table) -> pa.Table:
    return _tile_links(table, True)


def _lonely(rows: DataFrame, tokens: str) -> DataFrame:
    """(node, alone): how many tokens of a node no other node holds.  The
    holders of a token are a plain hash aggregate, summed before the shuffle;
    rows that repeat a node are no further holders."""
    held = rows.select("node", F.explode(tokens).alias("h")).groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return held.where("node = last").groupBy("node").agg(F.count("*").alias("alone"))


def _without_lonely(rows: DataFrame, lonely: DataFrame) -> DataFrame:
    """Rows with at most ``n - need`` tokens that no other node holds."""
    return rows.join(lonely, "node", "left").where(f"coalesce(alone, 0) <= n - {NEED}").drop("alone")


def _once(rows: DataFrame, tables: Tables) -> DataFrame:
    """``rows`` with one row a node: a doc_id that occurs several times with the
    text of its class has given several."""
    again = tables.write(rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node"), "again")
    if again.isEmpty():
        return rows
    return rows.join(again, "node", "left_anti").unionByName(rows.join(again, "node", "left_semi").dropDuplicates(["node"]))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_tokens: int = 500_000, count_links: bool = False) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, class_id)`` for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links, ``class_id``
    the smallest doc_id with the same shingle set, ``text_hash`` the row's
    ``xxhash64(text)``, which tells rows that share a doc_id apart.  With
    ``count_links`` a column ``n_links`` follows: the number of other shingle
    sets that the row's set links with.  Counting takes the product of every
    pair of a block, so its cost grows with the square of a group of near copies.

    Nulls and empties: a null text is empty; a text without words has set size
    0 and only itself as component.  A row whose doc_id is null is returned
    with its size and null component and links with nothing.  Repeated rows
    are equal texts and so of one class; rows that share a doc_id but not the
    text are linked each by its own text.  Extra columns are ignored.  An empty
    table gives no rows."""
    tables = Tables(docs.sparkSession, "ngram")
    base = id_and_text(docs, id_col, text_col)
    sets = tables.write(base.withColumn("th", F.xxhash64("text")).mapInArrow(
        frugal(measure), "doc_id long, th long, n long, s1 long, s2 long, sample array<long>"), "sets")
    named = sets.where("doc_id is not null and n > 0").drop("th")
    alike = ["n", "s1", "s2"]

    node = F.col("s1").alias("node")
    every = tables.write(named.groupBy(*alike).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("held")), "every")
    near = _without_lonely(every.select("*", node), _lonely(named.select(node, "sample"), "sample")).select(*alike, F.lit(True).alias("near"))
    # a class of one row without partner is its own component, which needs no table
    classes = tables.write(every.join(near, alike, "left").where("near or held > 1").drop("held"), "classes")
    chosen = classes.where("near").select(F.col("class_id").alias("doc_id"), "s1")
    wanted = base.join(broadcast_if_small(chosen, chosen.count() * 16), "doc_id").select("s1", "text")
    rows = _once(tables.write(wanted.mapInArrow(frugal(all_shingles), "node long, n long, tokens array<long>"), "rows"), tables)
    rows2 = tables.write(_without_lonely(rows, _lonely(rows, "tokens")), "rows2")
    tables.drop("rows", "again", "every")

    entries = rows2.select("node", "n", F.explode("tokens").alias("h"))
    held = tables.write(entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "held")
    shared = (entries.join(held, "h").groupBy("node", "n")
              .agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("cols")))
    first = F.expr(f"slice(cols, 1, greatest(cast(size(cols) + 1 - ({NEED}) as int), 0))")
    prefix = tables.write(shared.select("node", F.explode(F.transform(first, lambda x: x["h"])).alias("h")), "prefix")
    ends = tables.write(prefix.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                        .where("lo < hi").select("h", "lo"), "ends")
    stars = prefix.join(ends, "h").where("node > lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    blocks = tables.write(connected_components(stars, tables, "blocks"), "blocks")
    tables.drop("held", "prefix", "ends")

    links = tables.write(_multiply(rows2, blocks, tables, block_tokens, count_links), "links")
    labels = tables.write(connected_components(links.where("b is not null").select("a", "b"), tables, "labels"), "labels")
    degree = links.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    placed = tables.write(classes.select(*alike, "class_id", node).join(labels, "node", "left").join(degree, "node", "left"), "placed")
    smallest = placed.where("label is not null").groupBy("label").agg(F.min("class_id").alias("component_id"))
    named_classes = tables.write(
        placed.join(smallest, "label", "left")
        .select(*alike, "class_id", F.coalesce("component_id", "class_id").alias("component_id"), "n_links"), "named")
    tables.drop("rows2", "blocks", "links", "labels", "classes", "placed")
    return (sets.select("doc_id", "th", *alike).join(named_classes, alike, "left")
            .select("doc_id", F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
                    *([F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")] if count_links else [])))


def _tile(rows: DataFrame, tile, side) -> DataFrame:
    return rows.select(tile.alias("tile"), "label", side.cast("long").alias("side"), "node", "tokens")


def _linked(tiles: DataFrame, count: bool = False) -> DataFrame:
    return tiles.groupBy("tile").applyInArrow(tile_links_counted if count else tile_links, "a long, b long, n long")


def _multiply(rows: DataFrame, blocks: DataFrame, tables: Tables, block_tokens: int, count: bool) -> DataFrame:
    """Links (a, b, n) of all blocks: tiles of bounded size, dealt by tile.

    Blocks within ``block_tokens`` share tiles.  A larger one is cut into parts;
    every part meets part 0 first.  In a group of near copies that puts nearly
    all rows into one component, and pairs inside it need no product any more:
    only the rows outside it (and outside part 0) go on to meet every part.  If
    links are counted, every part meets every part."""
    placed = rows.join(blocks, "node").select("label", "node", "n", "tokens")
    sizes = tables.write(placed.groupBy("label").agg(F.sum("n").alias("total")), "sizes")
    parts = F.ceil(F.col("total") / block_tokens).cast("long")
    small, large = sizes.agg(F.sum(F.when(F.col("total") <= block_tokens, F.col("total"))),
                             F.count(F.when(F.col("total") > block_tokens, 1))).first()
    bins = max(1, -(-(small or 0) * 4 // block_tokens))
    with_size = placed.join(sizes.withColumn("parts", parts), "label")
    links = tables.write(_linked(_tile(with_size.where("parts = 1"), F.pmod(F.xxhash64("label"), F.lit(bins)).cast("string"), F.lit(2)), count),
                         "links-small")
    if not large:
        return links
    cut = tables.write(with_size.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))), "parts")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    name = lambda *c: F.concat_ws(" ", "label", *c)
    if count:
        met = cut.withColumn("j", each)
        side = F.when(F.col("part") == F.col("j"), 2).when(F.col("part") < F.col("j"), 0).otherwise(1)
        return links.unionByName(_linked(_tile(met, name(F.least("part", "j"), F.greatest("part", "j")), side), count))
    first = _tile(cut.where("part = 0").withColumn("j", each), name("j"), F.when(F.col("j") == 0, 2).otherwise(0)).unionByName(
        _tile(cut.where("part > 0"), name("part"), F.lit(1)))
    known = tables.write(_linked(first), "links-first")

    # what each row is connected to so far, and the component with the most rows of its block
    joined = connected_components(known.select("a", "b"), tables, "first").withColumnRenamed("label", "root")
    rooted = tables.write(cut.select("label", "node", "part").distinct().join(joined, "node", "left")
                          .withColumn("root", F.coalesce("root", "node")), "roots")
    largest = (rooted.groupBy("label", "root").agg(F.count("*").alias("c"))
               .groupBy("label").agg(F.max_by("root", F.struct("c", "root")).alias("hub")))
    outside = rooted.where("part > 0").join(largest, "label").where("root <> hub").select("label", "node")
    left = tables.write(cut.join(outside, ["label", "node"], "left_semi"), "outside")
    shares = tables.write(left.groupBy("label").agg(F.ceil(F.sum("n") / block_tokens).cast("long").alias("shares")), "shares")
    asked = left.join(shares, "label").withColumn("share", F.pmod(F.xxhash64("node", F.lit(3)), F.col("shares"))).withColumn("j", each)
    met = cut.where("part > 0").join(shares, "label").withColumn(
        "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    rest = _linked(_tile(asked.where("j > 0"), name("share", "j"), F.lit(0)).unionByName(_tile(met, name("share", "part"), F.lit(1))))
    return links.unionByName(known).unionByName(rest)
