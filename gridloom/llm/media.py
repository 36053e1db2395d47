"""Media columns: texts as lossless 8-bit FLAC audio, and PCM blocks read back from it.

``encode_media`` stores a payload (the text's UTF-8 bytes, then bytes 255 up to a positive
multiple of 576) as a FLAC stream in a binary column; ``decode_blocks`` decodes stored streams
into PCM blocks with the sample and byte offset of each, so that a reader can seek;
``media_digest`` decodes them into checksums and signal features. Each is one Arrow pass without
shuffle; batches are handled a few megabytes at a time, frames of all their texts together.

Defined results: null and empty texts store 576 bytes 255; equal texts give equal values; rows
are independent, so repeated rows repeat; an empty table gives an empty result; a stream with a
wrong checksum raises an error. A null stream gives null digests and no blocks.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac
from .common import table

CHUNK = 4 << 20


def _chunks(values: list, size=len):
    """Index ranges of about CHUNK bytes."""
    begin = held = 0
    for i, x in enumerate(values):
        held += size(x)
        if held >= CHUNK:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(values):
        yield begin, len(values)


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (-len(data) % flac.FRAME if data else flac.FRAME)


def encode_media(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_bytes (of the text), media (the stream)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _chunks(texts, lambda t: len(t or "") + flac.FRAME):
                media = flac.encode([payload(t) for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len((t or "").encode()) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def decode_blocks(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, block_no, sample_offset, byte_offset, pcm: a row for each frame of each stream; blocks
    of unsigned 8-bit samples, and where their frame begins in the stream."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [i for i, s in enumerate(streams) if s is not None]
            keys, streams = [keys[i] for i in keep], [streams[i] for i in keep]
            for a, b in _chunks(streams):
                for name, stream, x in zip(keys[a:b], streams[a:b], flac.decode(streams[a:b])[0]):
                    n = len(x) // flac.FRAME
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, batch.schema.field(0).type), pa.array(range(n), pa.int64()), pa.array(range(0, n * flac.FRAME, flac.FRAME), pa.int64()), pa.array(flac.seek_points(stream)[1]), pa.array([x[i : i + flac.FRAME].tobytes() for i in range(0, len(x), flac.FRAME)], pa.binary())], [key, "block_no", "sample_offset", "byte_offset", "pcm"])

    return media.select(key, "media").mapInArrow(run, f"`{key}` {kind}, block_no long, sample_offset long, byte_offset long, pcm binary")


def signal_feature(x: np.ndarray, kinds: np.ndarray) -> str:
    """Mean, energy, zero crossings and residual coding of decoded samples, as whole numbers."""
    s = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
    return f"frames={len(kinds)};predicted={int((kinds >= 8).sum())};sum={int(s.sum())};energy={int((s * s).sum())};crossings={crossings};peak={int(np.abs(s).max())}"


def media_digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    kind = media.schema[key].dataType.simpleString()
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            streams = batch.column(2).to_pylist()
            for a, b in _chunks(streams, lambda s: len(s or b"")):
                part = streams[a:b]
                some = [s for s in part if s is not None]
                read = iter(zip(*flac.decode(some)))
                rows = []
                for s in part:
                    if s is None:
                        rows.append((None,) * 6)
                        continue
                    x, kinds = next(read)
                    raw = x.tobytes()
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(s), hashlib.sha256(s).hexdigest(), signal_feature(x, kinds)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return media.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(encode_media(table(spark, sf_dir, "documents")))
