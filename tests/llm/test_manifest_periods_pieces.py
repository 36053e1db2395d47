"""The Merkle manifest, periodic runs and SentencePiece chunks against plain forms of them."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gridloom.llm import merkle, periods, pieces
from gridloom.llm.common import table

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root and, for each leaf, (siblings of each level)."""
    level, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, k in enumerate(at):
            paths[leaf].append((k % 2, level[k ^ 1] if k ^ 1 < len(level) else ""))
        level, at = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)], [k // 2 for k in at]
    return level[0], paths


@pytest.mark.parametrize("sizes, bits", [((1,), 10), ((2, 1), 1), ((5, 3, 1, 8), 2), ((37, 1, 16, 17), 10), ((70,), 2)])
def test_manifest(spark, sizes, bits):
    names = [None, "", "a", "ä"][: len(sizes)]
    rows = [(k, g, sha(f"{g}{k}"), "carried", "x") for g, n in zip(names, sizes) for k in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id int, lang string, leaf string, other string, root string")
    got = {(r["lang"], r["id"]): r for r in merkle.manifest(df, "lang", ["id"], bits=bits).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()}
    inner = {g: tree([sha(f"{g}{k}") for k in range(n)]) for g, n in zip(names, sizes)}
    root, outer = tree([inner[g][0] for g in names])
    assert len(got) == len(rows)
    for i, g in enumerate(names):
        for k in range(sizes[i]):
            r = got[g, k]
            path = [("LR"[1 - slot] if h else "") + h for slot, h in inner[g][1][k] + outer[i]]
            assert (r["subroot"], r["root"], r["path"], r["folded"], r["other"]) == (inner[g][0], root, path, root, "carried")


def test_manifest_edges(spark, odd, none):
    made = merkle.manifest(odd.withColumn("leaf", merkle.leaf_of([F.col("doc_id"), F.col("lang"), F.col("text")])), "lang", ["doc_id"])
    rows = made.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(rows) == 10 and all(r["folded"] == r["root"] for r in rows) and len({r["root"] for r in rows}) == 1
    assert len({r["subroot"] for r in rows if r["lang"] is None}) == 1 and made.columns[: len(odd.columns)] == odd.columns
    assert merkle.manifest(none.withColumn("leaf", F.lit("x")), "lang", ["doc_id"]).count() == 0
    one = spark.createDataFrame([(None, "é", 1)], "s string, t string, n int").select(merkle.leaf_of([F.col("s"), F.col("t"), F.col("n")])).first()[0]
    assert one == sha("-2:é1:1")


def test_equal_leaves(spark):
    """Rows that agree in everything: their places in any order, every proof used once."""
    df = spark.createDataFrame([(None, "en", sha("same"))] * 9, "id int, lang string, leaf string")
    rows = merkle.manifest(df, "lang", ["id"], bits=2).collect()
    assert sorted(map(tuple, (r["path"] for r in rows))) == sorted(tuple(("LR"[1 - s] if h else "") + h for s, h in p) for p in tree([sha("same")] * 9)[1])


def test_tampered(spark):
    rows = merkle.op13_merkle(spark, SF).collect()
    n_chars = {r["doc_id"]: r["n_chars"] for r in table(spark, SF, "documents").collect()}
    assert len(rows) == 200
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 > 0 or n_chars[r["doc_id"]] is None)


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        k = q
        while k < n:
            s = k
            while k < n and words[k] == words[k - q]:
                k += 1
            if k - s + q >= max(24, 3 * q):
                found.setdefault((s - q, k), q)
            k += k == s
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made_text(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        base = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50, 1000])) for _ in range(rng.choice([1, 2, 3, 5, 10, 20, 33, 70]))]
        if rng.random() < 0.3:
            base = base * rng.randint(1, 4) + [b"x"] + base[: rng.randint(0, len(base))]
        words += base * rng.choice([1, 1, 2, 3, 4, 8])
        if rng.random() < 0.3:
            words = words * rng.choice([1, 2, 3])
    return words[:700]


def test_runs_by_brute_force():
    rng = random.Random(8)
    documents = [made_text(rng) for _ in range(400)]
    got = periods.runs_of(documents)
    assert sum(map(len, got)) > 300 and max(p for r in got for _, _, p in r) > 64
    for words, runs in zip(documents, got):
        assert runs == plain_runs(words)


def test_runs_of_very_long_texts():
    line = [b"%d" % k for k in range(20)]
    assert periods.runs_of([[b"a"] * 300_000, line * 15_000, ([b"a"] * 20 + [b"b"] * 20) * 5000]) == [[(0, 300_000, 1)], [(0, 300_000, 20)], [(0, 200_000, 40)]]
    lines = [[b"%d_%d" % (j, k) for k in range(20)] for j in range(50)]
    rng = random.Random(2)
    picked = [rng.randrange(50) for _ in range(5000)]
    got = periods.runs_of([[w for j in picked for w in lines[j]]])[0]
    assert {s // 20 for s, _, p in got if p == 20} == {k for k in range(4998) if picked[k] == picked[k + 1] == picked[k + 2] and (k == 0 or picked[k - 1] != picked[k])}


def test_periods_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in periods.op12_periods(spark, SF).collect()}
    assert len(got) == 200 and sum(r[0] > 0 for r in got.values()) > 10
    for r in table(spark, SF, "documents").collect():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            a, words = g % n, words.copy()
            p, old = 1 + (n - a) // (3 + g % 8), words.copy()
            for i in range(a, n):
                words[i] = old[a + (i - a) % p]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        listed, kept = "".join("%d,%d,%d\n" % x for x in runs), " ".join(w for k, w in enumerate(words) if k not in gone)
        assert got[r["doc_id"]] == (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(kept))


def test_periods_edges(odd, none):
    rows = periods.find_runs(odd, change=periods.planted).collect()
    assert len(rows) == 10 and all(r["n_words"] == 0 and r["runs"] == [] and r["collapsed"] == "" for r in rows if r["doc_id"] in (2, 3, 8))
    long = next(r for r in rows if r["doc_id"] == 4)
    assert tuple(long["runs"][0]) == (0, 180_000, 9) and long["collapsed"] == "the cat and the dog sat on a mat."
    assert periods.find_runs(none).count() == 0


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(spark, model):
    parts = [" ", "  ", "▁", "a", "the", "ing", "\n", "\t", "日本", "é", "ﬁ", "　", "<s>", "</s>", "<0x41>", "😀", "\x00", "xxxxxxxxxxxxxxxxxxxx", "123", "."]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)] + ["", " ", "▁", "  ", "a" * 5000, "word " * 20000]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").repartition(3)
    for block_bytes in (500, pieces.BLOCK_BYTES):
        got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.decode(pieces.encode(df, block_bytes=block_bytes)).collect()}
        assert len(got) == len(texts) + 1 and got[-1] == ([], "")
        for i, text in enumerate(texts):
            ids = model.encode(text)
            assert got[i] == (ids, model.decode(ids) if ids else "")


def test_pieces_query(spark, model):
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.op11_pieces(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        ids = model.encode(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids) if ids else ""))


def test_pieces_edges(spark, odd, none):
    rows = pieces.decode(pieces.encode(odd)).collect()
    assert len(rows) == 10 and [r["ids"] for r in rows if r["doc_id"] in (2, 3)] == [[], []] and len({tuple(r["ids"]) for r in rows if r["doc_id"] == 6}) == 1
    assert pieces.decode(pieces.encode(none)).count() == 0
    named = odd.select(F.col("source").alias("doc_id"), "text")
    assert pieces.encode(named).count() == 10


def test_a_model_that_crosses_markers():
    class Crossing:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, k):
            return ["a", "a▁b"][k]

    with pytest.raises(ValueError):
        pieces.check_model(Crossing())


def test_lists_and_numbers_of_chunks():
    """Sliced, null and empty lists; chunks are numbered as they first come."""
    lists = pa.array([[9], [1, 2, 3], None, [], [4], [5, 6]], pa.list_(pa.int32()))
    assert pieces.lists_of(lists.slice(1, 4)) == [[1, 2, 3], [], [], [4]] and pieces.lists_of(lists.slice(0, 0)) == []
    number = pieces.numbering()
    assert pieces._looked_up(number, ["b", "a", "b"]).tolist() == [0, 1, 0] and pieces._looked_up(number, ["c", "a"]).tolist() == [2, 1]
    assert list(number) == ["b", "a", "c"] and pieces._looked_up(number, []).tolist() == []
