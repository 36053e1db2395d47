"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model crosses from other characters into a white-space marker (checked when the model is opened), so that a
text's segmentation is that of its chunks: a run of markers (blanks, or the marker itself) and the characters up to the next
one. Each distinct chunk of the corpus is segmented once, by the library, and its ids are joined back by position:

1. each block of documents (about ``BLOCK_BYTES`` of text, of one task) lists its distinct chunks, dealt by their hash into
   shards of the table (one for each ``SHARD_BYTES`` of text);
2. a shard makes the chunks of all blocks distinct, segments each once and gives every block its chunks' ids. A frequent chunk stands
   there as often as there are blocks, not as often as in texts;
3. each block, as numbers in its list of chunks, compressed, meets these ids, and each document's ids follow by position.

So texts are read twice and move once, as numbers; lists and ids move packed, a row for each block and shard. ``docs`` must give the
same rows in the same order both times, as a table does; a computed one should be written first (if it doesn't, that is an error, not another result).
Nothing of it reaches the driver but the number of bytes of text. A task holds one block, or one document if that is longer, or one shard.
Decoding is one Arrow pass of the library's own decoder.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows are encoded each; an empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MARKER, BLOCK_BYTES, SHARD_BYTES = "▁", 12 << 20, 32 << 20
BETWEEN = b"\xff"  # UTF-8 has no such byte
CHUNK = re.compile(f"[ {MARKER}]+[^ {MARKER}]*")
_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def model_of(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model of a file, opened once in each process."""
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raises unless chunks can be segmented alone: no piece goes on into a marker, and texts are taken as they are, but for a blank before them."""
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if re.search(f"[^{MARKER}]{MARKER}", p)]
    probe = f" ÅﬁＡ \t\n a  b{MARKER}"
    if crossing or model.normalize(probe) != MARKER + probe.replace(" ", MARKER) or not model.encode("a "):
        raise ValueError("this model's pieces cross white-space markers, or it rewrites texts")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, with the blank that the model puts before it."""
    return CHUNK.findall(" " + text) if text else []


def segment(chunks: list[str], model: sentencepiece.SentencePieceProcessor) -> list[list[int]]:
    """Each chunk's ids. Its first marker is the one that the model itself puts before a text; a marker alone, which the model
    doesn't put before an empty text, stands behind another chunk."""
    found = model.encode([c[1:] for c in chunks], num_threads=1)
    if any(len(c) == 1 for c in chunks):
        alone = model.encode("a ")[len(model.encode("a")) :]
        found = [f if len(c) > 1 else alone for c, f in zip(chunks, found)]
    return found


def numbering() -> defaultdict:
    """A dictionary that numbers its keys in the order in which they are first looked up."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    return number


def _looked_up(number: defaultdict, chunks: list) -> np.ndarray:
    return np.fromiter(map(number.__getitem__, chunks), np.uint32, len(chunks))


def _squeezed(data) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expanded(pack: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(pack.as_py())


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte: all low bytes first."""
    return _squeezed(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _numbers(pack: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_expanded(pack), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _dealt(chunks, shards: int) -> tuple[list[bytes], np.ndarray]:
    """Chunks as bytes, and the shard of each."""
    found = [c.encode() for c in chunks]
    return found, np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) % shards


def _blocks(batches, block_bytes: int, each):
    """Reads (id, text) in blocks: ``each(ids, texts)`` is called for every batch of a block's rows, with the block's number and
    whether it ends there."""
    block, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        texts = batch.column(1).to_pylist()
        sizes = np.cumsum([len(t or "") + 16 for t in texts])
        a = 0
        while a < len(texts):
            before = int(sizes[a - 1]) if a else 0
            b = min(len(texts), int(np.searchsorted(sizes, before + block_bytes - held)) + 1)
            held += int(sizes[b - 1]) - before
            yield from each(block, batch.column(0).slice(a, b - a), texts[a:b], held >= block_bytes)
            if held >= block_bytes:
                block, held = block + 1, 0
            a = b
    yield from each(block, None, [], True)


def _lists(docs: DataFrame, block_bytes: int, shards: int) -> DataFrame:
    """shard, block, chunks: the distinct chunks of each block in the order of their first places, packed by shard."""

    def run(batches):
        seen: dict[str, None] = {}

        def each(block, ids, texts, ends):
            for text in texts:
                seen.update(dict.fromkeys(chunks_of(text or "")))
            if ends and seen:
                found, shard = _dealt(seen, shards)
                seen.clear()
                order = np.argsort(shard, kind="stable")
                some, starts = np.unique(shard[order], return_index=True)
                packs = [_squeezed(BETWEEN.join([found[k] for k in part.tolist()])) for part in np.split(order, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), block)), pa.array(packs, pa.binary())], ["shard", "block", "chunks"])

        yield from _blocks(batches, block_bytes, each)

    return docs.mapInArrow(run, "shard int, block long, chunks binary")


def _table(lists: DataFrame, path: str) -> DataFrame:
    """lists to block, shard, lengths, pieces: for each block and shard its chunks' ids. A shard's distinct chunks are segmented here, each once."""

    def run(key, packs):
        number = numbering()
        which = [_looked_up(number, _expanded(p).split(BETWEEN)).astype(np.int64) for p in packs.column("chunks")]
        names = list(number)
        found = [i for a in range(0, len(names), 10_000) for i in segment([c.decode() for c in names[a : a + 10_000]], model_of(path))]
        lengths = np.array([len(i) for i in found], np.int64)
        flat, starts = np.fromiter((x for i in found for x in i), np.uint32, int(lengths.sum())), np.cumsum(lengths) - lengths
        rows = [(_planes(lengths[w]), _planes(flat[_places(starts[w], lengths[w])])) for w in which]
        return pa.table([packs.column("block"), packs.column("shard"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["block", "shard", "lengths", "pieces"])

    return lists.groupBy("shard").applyInArrow(run, "block long, shard int, lengths binary, pieces binary")


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of slices with these starts and lengths, all places in turn."""
    upto = np.cumsum(lengths)
    return np.repeat(starts - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)


def _numbered(docs: DataFrame, block_bytes: int, shards: int) -> DataFrame:
    """block, rows (ids, and where each one's chunks end), numbers (of its chunks, in the block's list), dealt (the shard of each chunk of the list)."""

    def run(batches):
        number = numbering()
        names, parts = [], []

        def each(block, ids, texts, ends):
            if texts:
                names.append(ids)
                parts.extend(_looked_up(number, chunks_of(text or "")) for text in texts)
            if ends and parts:
                rows = pa.record_batch([pa.concat_arrays(names), pa.array(np.cumsum([len(p) for p in parts]))], ["id", "end"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                made = (_squeezed(sink.getvalue()), _planes(np.concatenate(parts)), _planes(_dealt(number, shards)[1]))
                number.clear(), names.clear(), parts.clear()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([m], pa.binary()) for m in made)], ["block", "rows", "numbers", "dealt"])

        yield from _blocks(batches, block_bytes, each)

    return docs.mapInArrow(run, "block long, rows binary, numbers binary, dealt binary")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, ids (array of int): a row for each row of docs."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    check_model(model_of(path))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = -(-size // shard_bytes) or 1
    # tasks with less than a block's text each would list the same chunks again and again
    rows = rows.coalesce(-(-size // block_bytes) or 1)

    def run(left, right):
        order = np.argsort(right.column("shard").to_numpy())
        lengths, pieces = ([_numbers(right.column(c)[k]) for k in order.tolist()] for c in ("lengths", "pieces"))
        counts, lengths = [len(x) for x in lengths], np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64)
        pieces, starts = np.concatenate([np.zeros(0, np.uint32), *pieces]).astype(np.int32), np.cumsum(lengths) - lengths
        parts = []
        for pack in range(left.num_rows):  # one
            known = pa.ipc.open_stream(_expanded(left.column("rows")[pack])).read_all()
            dealt = _numbers(left.column("dealt")[pack])
            if np.unique(dealt, return_counts=True)[1].tolist() != counts:
                raise ValueError("the documents came in another order when they were read again: write them first")
            place = np.empty(len(dealt), np.int64)
            place[np.argsort(dealt, kind="stable")] = np.arange(len(dealt))  # of each chunk in the shards' lists
            which = place[_numbers(left.column("numbers")[pack])]
            ids = pieces[_places(starts[which], lengths[which])]
            ends = np.r_[0, np.cumsum(lengths[which])][np.r_[0, known.column("end").to_numpy()]]
            parts.append(pa.table([known.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], [id_col, "ids"]))
        return pa.concat_tables(parts)

    known = _table(_lists(rows, block_bytes, shards), path)
    return _numbered(rows, block_bytes, shards).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def lists_of(column: pa.ListArray) -> list[list[int]]:
    """The lists of a column (null: empty), without a scalar object for each number."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return [flat[a:b].tolist() for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the text of each row's ids."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    at = encoded.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [model_of(path).decode(ids) if ids else "" for ids in lists_of(part.column(at))]
                yield part.append_column(to, pa.array(texts, pa.string()))

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())]))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
