"""Packing against the tokenizer itself, and placing against its rules."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from gridloom.llm import packing, queries

SF, PATH = "/root/testdata/sf0.001", public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]


def check_packing(rows, ids):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for name, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[name])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[name][r["start"] : at].tobytes())
        assert at == len(ids[name])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # no padding
    assert set(by_doc) == set(ids)


def test_packing(spark):
    local = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    ids = dict(zip(local.doc_id, plain_ids(local.text)))
    rows = queries.QUERIES["op9_packing"](spark, SF).collect()
    check_packing(rows, ids)
    assert len(rows) < 1.5 * len(ids) + sum(len(i) // 4096 for i in ids.values())


@pytest.mark.parametrize("unit", [1, 3000, 1 << 22])
def test_odd_rows(odd, unit):
    """Every row of the odd table by a number of its own, with units from one row to all."""
    local = [(k, r["text"]) for k, r in enumerate(odd.collect())]
    texts = odd.sparkSession.createDataFrame(local, "doc_id long, text string").repartition(3)
    check_packing(packing.pack(texts, unit=unit).collect(), dict(zip((k for k, _ in local), plain_ids(t for _, t in local))))


def by_piece(lengths, capacity):
    """The pieces by document and by sequence, checked for gaps, overlaps and padding."""
    docs, sequences = {}, {}
    for d, start, n, s, offset in zip(*(c.tolist() for c in packing.place(np.array(lengths, np.int64), capacity))):
        docs.setdefault(d, []).append((start, n))
        sequences.setdefault(s, []).append((offset, n, d))
    for parts, ends in [(p, lengths[d]) for d, p in docs.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for begin, n, *_ in sorted(parts):
            assert begin == at and n > 0
            at += n
        assert at == ends if ends else at <= capacity and at & (at - 1) == 0
    assert sorted(docs) == list(range(len(lengths)))
    return docs, sequences


def test_places_of_random_lengths():
    r = random.Random(1)
    for _ in range(300):
        capacity = r.choice([1, 2, 8, 64, 256])
        _, sequences = by_piece([r.choice([1, r.randrange(1, capacity + 1), r.randrange(1, 4 * capacity + 1), capacity]) for _ in range(r.randrange(60))], capacity)
        assert sum(sum(n for _, n, _ in p) < capacity for p in sequences.values()) <= capacity.bit_length()


def test_bins_hold_a_fixed_count_of_their_class():
    capacity, r = 4096, np.random.default_rng(3)
    lengths = (r.lognormal(6, 1, 3000).astype(int) % capacity + 1).tolist()
    docs, sequences = by_piece(lengths, capacity)
    counts = {}
    shortest = min(lengths[d] for d, parts in docs.items() if len(parts) == 1 and (capacity // lengths[d]) < 4)
    for parts in sequences.values():
        own = [d for _, n, d in parts if n == lengths[d] and lengths[d] >= shortest]
        classes = {capacity // lengths[d] for d in own}
        if own:
            assert len(classes) == 1  # a bin is of one class
            counts.setdefault(classes.pop(), []).append(len(own))
    for j, found in counts.items():
        assert all(n == j for n in found) or sum(n != j for n in found) == 1  # a class's last bin may hold fewer
    assert sum(len(p) > 1 for p in docs.values()) <= len(sequences) and sum(len(p) for p in docs.values()) < 1.4 * len(lengths)


def test_word_ids():
    for text in ("Don't we'll 'S I'M", "a<|endoftext|>b <|x|>", "Straße ÉTÉ İstanbul ΟΔΟΣ", "x\x1cy\x85z w", "é ﬁ ①", "12,3.4!!??", "\x00\x7f a", "日本 🎉"):
        assert np.frombuffer(packing.token_bytes(text, PATH), "<u4").tolist() == plain_ids([text])[0].tolist()
