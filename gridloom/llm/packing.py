"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Lengths fall into reciprocal classes: class j holds what is longer than capacity / (j + 1) and at
most capacity / j, and a bin of class j takes exactly j documents, whole, but for the last one of a class in a unit, which may have
fewer. Workers are Spark's
tasks: each tokenises its own rows and, whenever about ``UNIT`` tokens have come together, fills
its classes' bins by itself, without a shuffle and without waiting for another worker.

Whatever such bins leave free is filled up with documents that are cut: the shortest of the unit, just as
many as are needed, laid end to end over the free places in order (in prose of mixed lengths about half of the documents, with a fifth of
the tokens, so that classes of very short documents get no bins). Documents longer than the
capacity first give whole sequences; their rest is classed like a document. What the fillers have
left in the end, less than one sequence, closes the unit at powers of two (that length in
binary), which need no padding. So there is no padding, and a document is only cut if it is longer than the
capacity, a filler at the end of a free place, or in the unit's last sequence.

Tokens come from a public tokenizer file; ids of white-space separated words, and of the parts of words that the tokenizer
takes one by one, are remembered in each Python worker (a bounded memory), as this tokenizer never joins across either. A task
holds one unit's ids (some 16 MB, or one document if that is longer).

Defined results: null and empty texts are the closing id alone (one piece of length 1); repeated
rows and rows with equal ids are packed each on its own; an empty table gives no pieces. Other
columns are ignored. Sequences depend on how rows are dealt to tasks, pieces' contents don't.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, table

CAPACITY, END_ID, REMEMBERED = 4096, 2, 300_000  # words, and as many parts of words
UNIT, UNIT_DOCUMENTS = 1 << 22, 1 << 17  # tokens, or documents, that a worker packs at once
# words of printable ASCII and composed Latin letters, which the tokenizer only lower-cases, and the parts that it then takes one by one
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_words: dict[str, "WordIds"] = {}


# a byte stands for a character in the tokenizer's pieces: visible Latin-1 ones for themselves, the others for those from 256 on
HIDDEN = [*range(33), *range(127, 161), 173]
AS_CHARACTERS = {byte: 256 + k for k, byte in enumerate(HIDDEN)}


class PartIds(dict):
    """Part of a word to its ids as little-endian unsigned 32-bit bytes: words with other marks around them, or capitals, share it."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[part] = found = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(part.encode().decode("latin-1").translate(AS_CHARACTERS)))
        return found


class WordIds(dict):
    """Word (bytes without ASCII white space) to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = PartIds(self.tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            found = b"".join(map(self.parts.__getitem__, PART.findall(text.lower())))
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def token_bytes(text: str | None, path: str, end_id: int = END_ID) -> bytes:
    """The text's ids and the closing one, four bytes each."""
    if path not in _words:
        _words[path] = WordIds(path)
    return b"".join(map(_words[path].__getitem__, (text or "").encode().split())) + end_id.to_bytes(4, "little")


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """The unit's documents (their lengths, at least 1) as pieces: document, start, length, sequence (from 0),
    offset."""
    lengths = np.asarray(lengths, np.int64)
    whole, rest = lengths // capacity, lengths % capacity
    long = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(long)) - np.repeat(np.cumsum(whole) - whole, whole)
    found = [(long, nth * capacity, np.full(len(long), capacity), np.arange(len(long)), np.zeros(len(long), np.int64))]

    order = np.argsort(-rest, kind="stable")[: np.count_nonzero(rest)]
    size = rest[order]
    fits = capacity // np.maximum(size, 1)  # the class: so many documents to a bin
    new_class = np.r_[True, fits[1:] != fits[:-1]][: len(fits)]
    rank = np.arange(len(fits)) - np.maximum.accumulate(np.where(new_class, np.arange(len(fits)), 0))
    first = np.flatnonzero(rank % np.maximum(fits, 1) == 0)  # each bin's first document
    ends = np.cumsum(size)
    fill = np.add.reduceat(size, first) if len(first) else size
    free = np.cumsum(capacity - fill)
    left = size.sum() - np.cumsum(fill)  # tokens beyond each bin, in shorter documents
    bins = int(np.searchsorted(free > left, True))  # as many as the documents beyond them fill up
    kept = int(first[bins]) if bins < len(first) else len(size)
    own = np.searchsorted(first[:bins], np.arange(kept), side="right") - 1
    offset = (ends - size)[:kept] - (ends - size)[first[:bins]][own] if kept else np.zeros(0, np.int64)
    found.append((order[:kept], (lengths - rest)[order[:kept]], size[:kept], len(long) + own, offset))

    # fillers end to end over the free places, the last of which are powers of two
    over = int(size[kept:].sum())
    last = over - (int(free[bins - 1]) if bins else 0)
    closing = np.array([1 << b for b in range(capacity.bit_length() - 1, -1, -1) if last >> b & 1], np.int64)
    room = np.r_[capacity - fill[:bins], closing]
    base = np.r_[fill[:bins], np.zeros(len(closing), np.int64)]
    place_of = np.flatnonzero(room)
    room_start = (np.cumsum(room) - room)[place_of]
    doc_start = (ends - size)[kept:] - (ends - size)[kept] if kept < len(size) else np.zeros(0, np.int64)
    at = np.unique(np.r_[room_start, doc_start])
    which, where = np.searchsorted(doc_start, at, side="right") - 1, np.searchsorted(room_start, at, side="right") - 1
    filler = order[kept:][which]
    found.append((filler, (lengths - rest)[filler] + at - doc_start[which], np.diff(np.r_[at, over]), len(long) + place_of[where], base[place_of[where]] + at - room_start[where]))
    return tuple(np.concatenate(c) for c in zip(*found))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row a piece."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    path = path or public_tokenizers.path("word_bpe_49k.json")
    id_type = docs.schema[id_col].dataType.simpleString()

    def packed(names, ids, first, kind):
        lengths = np.array([len(i) // 4 for i in ids], np.int64)
        doc, start, length, sequence, offset = place(lengths, capacity)
        sums = [zlib.crc32(memoryview(ids[d])[a:b]) for d, a, b in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist())]
        for a in range(0, len(doc), 50_000):
            b = a + 50_000
            columns = (start[a:b], length[a:b], sums[a:b], lengths[doc[a:b]], first + sequence[a:b], offset[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([names[d] for d in doc[a:b].tolist()], kind), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def run(batches):
        names, ids, held, kind, sequences = [], [], 0, None, TaskContext.get().partitionId() << 40
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                ids.append(token_bytes(text.as_py(), path, end_id))
                held += len(ids[-1]) // 4
                if held >= unit or len(ids) >= UNIT_DOCUMENTS:
                    yield from packed(names, ids, sequences, kind)
                    sequences += held  # more than there were sequences
                    names, ids, held = [], [], 0
        if ids:
            yield from packed(names, ids, sequences, kind)
        names, ids = [], []
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
