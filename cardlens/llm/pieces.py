"""SentencePiece encoding and decoding by a table of distinct chunks (operator 4).

A chunk is a run of white-space markers and the characters up to the next
marker.  If no piece of the model has a marker after another character, no
piece can cross from one chunk into the next, so a text's ids are those of its
chunks in order.  Texts are cut into blocks of about ``block_chars`` characters:
the distinct chunks of a block, and for each position of each text the place of
its chunk among them.  Each distinct chunk is segmented, decoded and written out
once, by the library, and the results are joined back by position.

The table of chunks has one of two scopes:

* ``block`` (as registered): the block's own chunks.  Nothing is shuffled; a
  task holds one block at a time, bounded in characters and not in chunks.  A
  longer text is a block of its own, whole.
* ``corpus``: blocks are a written table, the distinct chunks of all blocks are
  segmented once into another, and each block's are joined from it: a row moves
  for each distinct chunk of a block, not for each position.  A frequent chunk
  has one row a block, and the adaptive skew join splits those.  It saves half of the
  segmentations on texts with many invented words, and costs shuffles of more
  than 1.5 times the Parquet input.

A model with pieces that cross chunks, or whose normaliser is not the identity,
is given whole texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, frugal, id_and_text

MARK = "▁"
#: Chunks: markers and what follows up to the next; or markers at the end.
CHUNK = re.compile(" +[^ ]*")


def load(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def chunked(model) -> bool:
    """Whether texts of this model may be encoded chunk by chunk."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    plain = all(model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or not crossing.search(model.id_to_piece(i))
                for i in range(model.get_piece_size()))
    # the normaliser adds one marker in front and maps blanks to markers, and nothing else
    probe = "a  Åﬁ①　b\téé "
    return plain and model.normalize(probe) == (" " + probe).replace(" ", MARK) and not model.normalize("")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, markers as blanks; joined they are the text behind one blank."""
    return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def segment(model, chunks: list[str]) -> tuple[list[list[int]], list[str]]:
    """Ids of each chunk, and the text that they decode to inside a longer one."""
    # the library puts one marker in front of what it is given; given nothing it returns nothing, not a marker
    ids = [x or [model.piece_to_id(MARK)] for x in model.encode([c[1:] for c in chunks], num_threads=1)]
    return ids, [" " + text for text in model.decode(ids)]  # and takes the first marker off what it decodes


def blocks_of(block_chars: int):
    """(doc_id, text) -> (block, doc_ids, counts, chunks, places): whole texts of
    about ``block_chars`` characters; text i has ``counts[i]`` chunks, in order
    those at its places in ``chunks``."""

    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, counts, places, size, index = [], [], [], 0, {}

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([list(index)], pa.list_(pa.string())),
                 pa.ListArray.from_arrays(pa.array([0, sum(counts)], pa.int32()), pa.array(np.concatenate(places)))],
                names=["block", "doc_ids", "counts", "chunks", "places"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    found = chunks_of(text or "")
                    for c in found:
                        if c not in index:
                            index[c] = len(index)
                    ids.append(doc_id)
                    counts.append(len(found))
                    places.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
                    size += len(text or "")
                    if size >= block_chars or len(ids) >= 1 << 16:
                        yield block()
                        made += 1
                        ids, counts, places, size, index = [], [], [], 0, {}
        if ids:
            yield block()

    return run


def segmenter(path: str):
    """(chunk) -> (chunk, ids, decoded)."""

    def run(batches):
        model = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                chunks = batch.column(0).slice(k, 4096)
                ids, decoded = segment(model, chunks.to_pylist())
                yield pa.RecordBatch.from_arrays([chunks, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                                                 names=["chunk", "ids", "decoded"])

    return run


def gatherer(results, tail: list[int]):
    """A block and its rows of the chunk table -> ``results`` of each text."""

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        return _by_position(block, rows.column("ids").to_pylist(), rows.column("decoded").to_pylist(), results, tail)

    return run


def by_block(path: str, block_chars: int, results, tail: list[int]):
    """(doc_id, text) -> ``results`` of each text, block by block."""

    def run(batches):
        model = load(path)
        for block in blocks_of(block_chars)(batches):
            ids, decoded = segment(model, block.column("chunks").flatten().to_pylist())
            yield from _by_position(block, ids, decoded, results, tail).to_batches(max_chunksize=1024)

    return run


def _by_position(block, ids: list, decoded: list, results, tail: list[int]) -> pa.Table:
    """``results`` of the texts of one block, from ids and text of its chunks."""
    places = block.column("places")[0].values.to_numpy()
    ends = np.cumsum(block.column("counts")[0].as_py())
    texts = (places[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends))
    return results(block.column("doc_ids")[0].values, ids, decoded, texts, tail)


def whole_texts(doc_ids: pa.Array, ids: list, decoded: list, texts, tail: list[int]) -> pa.Table:
    """Ids and decoded text of each text, from those of its chunks."""
    found, plain = [], []
    for places in texts:
        found.append([i for place in places for i in ids[place]] + tail)
        plain.append("".join([decoded[place] for place in places])[1:])
    return pa.table({"doc_id": doc_ids, "ids": pa.array(found, pa.list_(pa.int32())), "decoded": pa.array(plain, pa.string())})


def digests(doc_ids: pa.Array, ids: list, decoded: list, texts, tail: list[int]) -> pa.Table:
    """Number of ids and digests of each text; ids are written out once a chunk."""
    sizes, written = [len(x) for x in ids], [" ".join(map(str, x)) for x in ids]
    end = [" ".join(map(str, tail))] if tail else []
    counts, ids_sha, texts_sha = [], [], []
    for places in texts:
        counts.append(sum([sizes[place] for place in places]) + len(tail))
        ids_sha.append(_sha(" ".join([written[place] for place in places] + end)))
        texts_sha.append(_sha("".join([decoded[place] for place in places])[1:]))
    return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(counts, pa.int64()),
                     "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(texts_sha, pa.string())})


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, end_id: bool, block_chars: int,
             scope: str, results, schema: str) -> DataFrame:
    model = load(model_path)
    tail = [model.eos_id()] if end_id else []
    base = id_and_text(docs, id_col, text_col)
    if scope == "text" or not chunked(model):
        return base.mapInArrow(frugal(_by_text(model_path, results, tail)), schema)
    if scope == "block":
        return base.mapInArrow(frugal(by_block(model_path, block_chars, results, tail)), schema)
    tables = Tables(docs.sparkSession, "pieces")
    blocks = tables.write(base.mapInArrow(frugal(blocks_of(block_chars)),
                                          "block long, doc_ids array<long>, counts array<long>, chunks array<string>, places array<int>"), "blocks")
    chunks = blocks.select(F.explode("chunks").alias("chunk")).distinct()
    table = tables.write(chunks.mapInArrow(frugal(segmenter(model_path)), "chunk string, ids array<int>, decoded string"), "chunks")
    placed = blocks.select(F.col("block").alias("at"), F.posexplode("chunks").alias("place", "chunk")).join(table, "chunk").drop("chunk")
    return (blocks.select("block", "doc_ids", "counts", "places").groupBy("block")
            .cogroup(placed.groupBy("at")).applyInArrow(gatherer(results, tail), schema))


def _by_text(path: str, results, tail: list[int]):
    """The results of whole texts: each is its own, only chunk."""

    def run(batches):
        model = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                ids = [model.encode(text or "") for text in rows.column(1).to_pylist()]
                decoded = [" " + model.decode(x) for x in ids]
                yield from results(rows.column(0), ids, decoded, ([i] for i in range(len(ids))), tail).to_batches()

    return run


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  end_id: bool = True, block_chars: int = 1 << 22, scope: str = "block") -> DataFrame:
    """``(doc_id, ids, decoded)`` for each row: all ids, and their text.

    A null or empty text has the end id alone and decodes to the empty text.
    Null doc_ids, repeated rows and extra columns are no special case; an empty
    table gives no rows.  ``model_path`` must be readable on the executors.
    ``block_chars`` and ``scope`` (``block``, ``corpus``, or ``text`` for whole
    texts) only steer how chunks are shared, not the result."""
    return _encoded(docs, model_path, id_col, text_col, end_id, block_chars, scope, whole_texts,
                    "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: bool = True, block_chars: int = 1 << 22, scope: str = "block") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: as ``encode_decode``,
    with digests taken in the task so that ids and texts need not leave it."""
    return _encoded(docs, model_path, id_col, text_col, end_id, block_chars, scope, digests,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)`` of rows with an array of ids; null ids: empty text."""

    def run(batches):
        model = load(model_path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    chosen = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return chosen.mapInArrow(frugal(run), "doc_id long, decoded string")
