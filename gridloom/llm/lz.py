"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the shortest that is not
in the dictionary yet, and joins it. Every phrase is hashed, and the ``SIGNATURE`` least hashes
are the fingerprint: a minimum-hash signature of the set of phrases. Texts that would compress
each other share phrases; the share of common phrases among the least hashes of both is their
likeness (Jaccard similarity of the phrase sets, exact for small sets).

``fingerprints`` is one Arrow pass. ``with_successors`` also compares each document with the next
one by descending id and with an edited text that takes the next one's beginning. For that,
documents are dealt into blocks of neighbouring ids (bounds from approximate quantiles, a number
of blocks, not of rows, on the driver); the first row of a block is also sent to the block
before it, so that blocks can be worked on alone. Texts are shuffled once, and only one pending
document is held per task. The parse of the part that a text and its edited form share is done once.

Defined results: null and empty texts have no phrases and an empty fingerprint, like 1 to one
another and 0 to any other; equal texts have equal fingerprints; rows with equal ids follow one
another by text; null ids come last; a single row is its own successor; an empty table gives an
empty result. Other columns are ignored. Ids are numbers.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

SIGNATURE, MASK, BLOCKS_A_PARTITION = 64, (1 << 61) - 1, 4


class Parse:
    """An unfinished parse: the dictionary, the place in it, and the phrases' hashes."""

    __slots__ = ("tree", "node", "hashes")

    def __init__(self, tree=None, node=0, hashes=None):
        self.tree, self.node, self.hashes = tree or {}, node, hashes or [0]

    def copy(self) -> "Parse":
        return Parse(self.tree.copy(), self.node, self.hashes.copy())

    def feed(self, data: bytes) -> "Parse":
        tree, node, hashes = self.tree, self.node, self.hashes
        get, add, size = tree.get, hashes.append, len(hashes)
        for byte in data:
            step = node + byte  # nodes are multiples of 256
            node = get(step)
            if node is None:
                tree[step] = size << 8
                add((hashes[step >> 8] * 1099511628211 + (step & 255) + 1) & MASK)
                size += 1
                node = 0
        self.node = node
        return self

    def signature(self, k: int = SIGNATURE) -> np.ndarray:
        """The least hashes in order; the last phrase counts even if it is a known one."""
        h = np.array(self.hashes[1:], np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = ((h ^ (h >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
        return np.unique(np.partition(h, k)[:k] if len(h) > k else h)


def likeness(a: np.ndarray, b: np.ndarray, k: int = SIGNATURE) -> float:
    """Estimated Jaccard similarity of the sets behind two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twin = both[1:] == both[:-1]
    union = np.append(both[:-1][~twin], both[-1])[:k]
    return float(np.count_nonzero(both[:-1][twin] <= union[-1]) / len(union))


def as_text(signature: np.ndarray) -> str:
    """Base64 of the hashes, four bytes each."""
    return base64.b64encode(signature.astype(">u4").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def fingerprint_of(text: str | None, k: int = SIGNATURE) -> str:
    return as_text(Parse().feed((text or "").encode()).signature(k))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SIGNATURE) -> DataFrame:
    """id, fingerprint: a row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint_of(t.as_py(), k) for t in batch.column(1)], pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def _in_blocks(docs: DataFrame, partitions: int, blocks: int) -> DataFrame:
    """docs (__id, __text) with __block and __own, ready to be read block by block in descending
    order; at the end of each block, with __own false, stands the next block's first row."""
    bounds = docs.select(F.percentile_approx("__id", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] or []
    splits = [-float("inf"), *sorted({float(b) for b in bounds} or {0.0}), float("inf")]
    blocked = Bucketizer(splits=splits, inputCol="__x", outputCol="__block", handleInvalid="keep").transform(docs.withColumn("__x", F.col("__id").cast("double"))).drop("__x")
    blocked = blocked.withColumn("__block", F.coalesce(F.when(F.col("__id").isNotNull(), F.col("__block")), F.lit(-1.0)).cast("int"))
    heads = sorted((tuple(r) for r in blocked.groupBy("__block").agg(F.max("__id")).collect()), key=lambda r: -r[0])  # a row a block
    listed = [f"({b}, {'CAST(NULL AS BIGINT)' if head is None else head}, {heads[i - 1][0]})" for i, (b, head) in enumerate(heads)] or ["(0, 0, 0)"]
    # as many rows as blocks, of 24 bytes
    known = F.broadcast(docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(listed)} AS t(__b, __head, __before)"))
    joined = blocked.join(known, blocked["__block"] == known["__b"])
    places = F.array(F.struct(F.col("__block").alias("b"), F.lit(True).alias("o")), F.when(F.col("__id").eqNullSafe(F.col("__head")), F.struct(F.col("__before").alias("b"), F.lit(False).alias("o"))))
    dealt = joined.select("__id", "__text", F.explode(F.array_compact(places)).alias("p")).select(F.col("p.b").alias("__block"), F.col("p.o").alias("__own"), "__id", "__text")
    return dealt.repartition(partitions, "__block").sortWithinPartitions("__block", F.col("__own").desc(), F.col("__id").desc_nulls_last(), "__text")


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SIGNATURE) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row
    for each row of docs. The edited text is the text with its last half replaced by as much of
    the next one's beginning as there is."""
    kind = docs.schema[id_col].dataType.simpleString()
    partitions = shuffle_partitions(docs.sparkSession)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        waiting = None
        for batch in batches:
            ids, rows = [], []
            for block, own, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if waiting is None and not own:
                    continue
                kept = text[: len(text) - len(text) // 2]
                half = Parse().feed(kept.encode())
                whole = half.copy().feed(text[len(kept) :].encode()).signature(k)
                if waiting is not None:
                    name0, text0, kept0, half0, whole0 = waiting
                    taken = text[: len(text0) // 2]
                    edited = half0.feed(taken.encode()).signature(k)
                    ids.append(name0)
                    rows.append((len(text0), hashlib.sha256((kept0 + taken).encode()).hexdigest(), as_text(whole0), as_text(edited), likeness(whole0, edited, k), likeness(whole0, whole, k)))
                waiting = (name, text, kept, half, whole) if own else None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(2).type), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    dealt = _in_blocks(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), partitions, BLOCKS_A_PARTITION * partitions)
    return dealt.select("__block", "__own", "__id", "__text").mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successors(table(spark, sf_dir, "documents"))
