"""Results against brute force, exact round trips and held-out labels, on the small tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import components, flac, language, licenses, lz, media, mixing, quality, queries, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas()


def test_mixing_is_repeated_resharing(spark, docs, local):
    got = queries.QUERIES["op1_mixing"](spark, SF).toPandas().merge(local[["doc_id", "source"]])
    size = got.groupby("source")["size"].sum().sort_index()
    weight, capped = dict(zip(size.index, [5, 2, 1] * len(size))), set()
    while True:
        rest, w = size.sum() - sum(3 * size[s] for s in capped), sum(weight[s] for s in size.index if s not in capped)
        target = {s: 3 * size[s] if s in capped else rest * weight[s] / w for s in size.index}
        new = {s for s in size.index if target[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    assert all(abs(target[r.source] - r.target) < 1e-6 for r in got.itertuples()) and (got.taken <= 3 * got["size"]).all()


@pytest.mark.parametrize("sf,near", [("sf0.001", None), ("sf0.01", 0.05), ("sf0.1", 0.02)])
def test_sources_come_near_their_targets(spark, sf, near):
    """Within half of the largest document always, and within some percent where a source has 50 documents or 500."""
    got = queries.QUERIES["op1_mixing"](spark, f"/root/testdata/{sf}").toPandas()
    for (_, target), part in got.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - target) <= part["size"].max() / 2 + 1e-6
        assert near is None or abs(part.taken.sum() - target) <= near * target


def test_a_hot_source_and_rows_without_ids(spark):
    r = random.Random(3)
    rows = [(None if i % 3 == 0 else i, f"n{i} " * r.randrange(1, 60), "hot" if i % 3 else "b") for i in range(3000)]
    got = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 30 and part.copies.nunique() == 2
    again = mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).toPandas()
    assert sorted(got.copies.groupby(got.text).first().items()) == sorted(again.copies.groupby(again.text).first().items())


def test_mixing_caps(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 50), ("c", 1000), (None, 10), ("d", 5)])]
    t = {r["source"]: r for r in mixing.with_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert t["a"]["target"] == 3 and t["b"]["target"] == 150 and t["d"]["target"] == 15 and t[None]["target"] == 30 and t["c"]["target"] == 1066 - 198


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    both = [df[sorted(df.columns)].astype(object).where(df.notna(), None).sort_values("doc_id").values.tolist() for df in (got, want)]
    assert both[0] == both[1]


def test_language_held_out(spark, docs, local):
    got = queries.QUERIES["op2_language"](spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas())
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id)


def test_language_reads_whole_texts():
    rows, owner, filled = language.windows_of([b"a" * 300, b"", b"b"])
    assert owner.tolist() == [0, 0, 0, 2] and filled.tolist() == [128, 128, 44, 1]


def test_convolution_is_plain():
    """Probabilities from loops over filters, widths and positions."""
    net, r = language.ByteNet(["a", "b", "c"]), np.random.default_rng(5)
    windows = r.integers(0, 256, (3, language.WINDOW), dtype=np.uint8)
    windows[2, 40:] = 0
    for window, got in zip(windows, net.probabilities(windows)):
        top = []
        for f in range(len(net.filters)):
            width = language.WIDTHS[f // language.FILTERS]
            own = net.filters[f].reshape(-1, language.DIMS)
            best = max(sum(float(own[o] @ net.emb[window[i + o]]) for o in range(width)) for i in range(language.POSITIONS))
            top.append(max(0.0, best + net.bias[f]))
        e = np.exp(np.array([sum(o * t for o, t in zip(row, top)) for row in net.out]) + net.base)
        assert np.allclose(got, e / e.sum(), atol=1e-4)


def test_gradients_are_slopes_of_the_loss():
    net, r = language.ByteNet(["a", "b"]), np.random.default_rng(6)
    for k in ("emb", "filters", "bias", "out", "base"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    windows, labels, weight = r.integers(1, 256, (5, language.WINDOW), dtype=np.uint8), np.array([0, 1, 1, 0, 1]), np.array([1.3, 0.8])
    grads, _ = net.gradients(windows, labels, weight)
    for k, g in grads.items():
        values = getattr(net, k)
        for at in [tuple(p) for p in np.argwhere(np.abs(g) > np.abs(g).max() / 3)[:6]]:
            kept, step, loss = values[at], 1e-5, []
            for s in (step, -step):
                values[at] = kept + s
                loss.append(net.gradients(windows, labels, weight)[1])
            values[at] = kept
            assert abs((loss[0] - loss[1]) / (2 * step) - g[at]) < 1e-5 + 1e-3 * abs(g[at])


def test_language_sample_is_bounded(spark):
    """Whole texts only; a language's sampled texts stay under the bound together, and so does the number of rows."""
    long = [(i, "ab " * (100_000 if i % 10 == 0 else 10), f"l{i % 4}") for i in range(400)]
    taken, found = [], language.windows_of
    try:
        language.windows_of = lambda texts: taken.append(texts) or found(texts)
        language.train(spark.createDataFrame(long, "doc_id long, text string, lang string"), sample=80, sample_bytes=40_000)
        language.train(spark.createDataFrame([(i, "abc", f"l{i}") for i in range(600)], "doc_id long, text string, lang string"), sample=50)
    finally:
        language.windows_of = found
    assert set(map(len, taken[0])) == {30} and len(taken[0]) > 20 and 10 < len(taken[1]) < 120


def test_media_round_trip(spark, docs, local):
    text = dict(zip(local.doc_id, local.text))
    for r in queries.QUERIES["op3_media"](spark, SF).collect():
        want = media.payload(text[r["doc_id"]])
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-32:]) and r["n_bytes"] == len(text[r["doc_id"]].encode())
    blocks = media.decode_blocks(media.encode_media(docs)).toPandas().sort_values(["doc_id", "block_no"])
    for name, part in blocks.groupby("doc_id"):
        assert b"".join(part.pcm) == media.payload(text[name]) and (part.sample_offset == part.block_no * 576).all()


def test_flac_of_all_kinds():
    r = np.random.default_rng(2)
    loud = np.where(np.arange(576) == 300, 255, 128).astype(np.uint8)
    wave = (128 + 100 * np.sin(np.arange(576 * 300) / 20)).astype(np.uint8)
    kinds = [bytes(576), bytes(range(256)) * 9, r.integers(0, 256, 576 * 4, dtype=np.uint8).tobytes(), loud.tobytes(), wave.tobytes()]
    streams = flac.encode(kinds)
    back, found = flac.decode(streams)
    assert [b.tobytes() for b in back] == kinds and {0, 1} < set(np.concatenate(found).tolist())
    assert hashlib.md5(bytes(b ^ 128 for b in kinds[3])).digest() in streams[3]


def test_flac_finds_damage():
    wave = (128 + 100 * np.sin(np.arange(576 * 20) / 20)).astype(np.uint8).tobytes()
    stream = flac.encode([wave])[0]
    start = flac.seek_points(stream)[1]
    flipped = lambda at, bits=4: bytes(b ^ (bits if i == at else 0) for i, b in enumerate(stream))
    for at, says in ((start[3] + 4, "CRC-8"), (start[3] + 60, "CRC-16"), (len(stream) - 1, "CRC-16"), (30, "MD5"), (0, "not a FLAC"), (4, "seek table"), (50, "seek table")):
        with pytest.raises(ValueError, match=says):
            flac.decode([flipped(int(at))])
    r = random.Random(4)
    for at, bit in [(a, b) for a in range(60) for b in range(8)] + [(r.randrange(len(stream)), r.randrange(8)) for _ in range(200)]:
        try:
            assert flac.decode([flipped(at, 1 << bit)])[0][0].tobytes() == wave
        except ValueError:
            pass
    for end in (3, 10, 41, 100, len(stream) - 1):
        with pytest.raises(ValueError):
            flac.decode([stream[:end]])


def test_toxicity(spark):
    got = queries.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").toPandas().merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas())
    held = got[got.held_out]
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id)
    toxic, found = held.toxic == 1, held.predicted == 1
    assert (found & toxic).sum() / toxic.sum() > 0.85 and (found & toxic).sum() / found.sum() > 0.9 and found[~toxic].mean() < 0.02


def test_grammar():
    g = toxicity.Grammar({"idiot": 4.0, "moro*": 3.0})
    w = g.weight
    assert w("you are an idiot") == 5.0 and w("an idiot") == 4.0 and w("morons here") == 3.0
    assert w("not an idiot") < w("an idiot") and w("she said idiot") < w("she, idiot") and w("not you. an idiot") == 4.0
    assert w("a fine day") == 0 and len(g.matches("an idiot. fine. moron")) == 2


def test_fingerprints(spark, local):
    def phrases(data):
        seen, start = set(), 0
        for end in range(1, len(data) + 1):
            if data[start:end] not in seen:
                seen.add(data[start:end])
                start = end
        return seen

    ordered = local.sort_values("doc_id", ascending=False)
    got = queries.QUERIES["op5_fingerprints"](spark, SF).toPandas().set_index("doc_id")
    errors = []
    for k, r in enumerate(ordered.itertuples()):
        after = ordered.text.iloc[(k + 1) % len(ordered)]
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        mine = got.loc[r.doc_id]
        assert mine.n_chars == len(r.text) and mine.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert mine.fingerprint == lz.fingerprint_of(r.text) and mine.edited_fingerprint == lz.fingerprint_of(edited)
        a, b, c = (phrases(t.encode()) for t in (r.text, edited, after))
        errors.append(abs(mine.near_edited - len(a & b) / len(a | b)))
        errors.append(abs(mine.near_next - len(a & c) / len(a | c)))
    assert np.mean(errors) < 0.05 and max(errors) < 0.3 and (got.near_edited > got.near_next).mean() > 0.97


def test_small_likeness_is_exact():
    a, b = (lz.from_text(lz.fingerprint_of(t)) for t in ("abcabd", "abcxyz"))
    assert lz.likeness(a, a) == 1.0 and lz.likeness(a, lz.from_text("")) == 0.0
    assert lz.likeness(a, b) == 3 / 8  # a, b, c, ab, d and a, b, c, x, y, z


def plain_model(trusted, asked, order=4):
    """Interpolated modified Kneser-Ney, straight from its formulas."""
    from collections import Counter, defaultdict

    grams = lambda t: [(b"\xff" * (order - 1) + t)[i : i + order] for i in range(len(t))]
    levels = {order: Counter(g for t in trusted for g in grams(t))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cut, sums, rest = {}, {}, {}
    for n, c in levels.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0
        d = [max(0.05, min(k - 0.05, k - (k + 1) * y * b / a)) if a and n1 else f for k, a, b, f in ((1, n1, n2, 0.6), (2, n2, n3, 1.1), (3, n3, n4, 1.5))]
        cut[n] = lambda v, d=d: d[min(v, 3) - 1]
        s, r = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            s[g[:-1]] += v
            r[g[:-1]] += cut[n](v)
        sums[n], rest[n] = s, r

    def p(g):
        if not g:
            return 1 / 256
        n, c = len(g), g[:-1]
        if c not in sums[n]:
            return p(g[1:])
        v = levels[n].get(g, 0)
        return (v - cut[n](v) if v else 0) / sums[n][c] + rest[n][c] / sums[n][c] * p(g[1:])

    return [sum(np.log(p(g)) for g in grams(t)) for t in asked]


def test_quality_model_is_plain(spark):
    r = random.Random(4)
    words = ["the", "cat", "sat", "mat", "häus", "on"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(5, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)], "doc_id long, quality int")
    got = quality.judge(docs, labels).toPandas().set_index("doc_id")
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0]
    logs = plain_model([texts[i].encode() for i in range(40) if i not in held], [t.encode() for t in texts])
    mean = -sum(logs[i] for i in held) / sum(len(texts[i].encode()) for i in held)
    for i, t in enumerate(texts):
        want = np.exp((-logs[i] + quality.PRIOR * mean) / (len(t.encode()) + quality.PRIOR))
        assert abs(got.perplexity[i] - want) < 1e-6 * want


def test_quality_drops_junk_and_keeps_text(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op6_quality"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas())
    labelled = got.merge(spark.read.parquet(f"{sf}/labels.parquet").filter("quality IS NOT NULL").toPandas())
    bad, good = labelled[labelled.quality == 0], labelled[labelled.quality == 1]
    assert bad.keep.mean() < 0.08 and good.keep.mean() > 0.985
    junk = got.text.str.contains(r"!! .*!! |\$\$\$.*&&&| \| .* \| ", regex=True)
    repeated = ~junk & got.text.map(lambda t: np.mean([a == b for a, b in zip((t or "").split(), (t or "").split()[1:])] or [0]) > 0.3)
    plain = ~junk & got.text.map(lambda t: np.mean([a == b for a, b in zip((t or "").split(), (t or "").split()[1:])] or [0]) <= 0.02)
    assert got[junk].keep.mean() < 0.01 and got[repeated].keep.mean() < 0.3 and got[plain].keep.mean() > 0.98


def test_quality_of_rows_without_id_or_language(spark):
    """Junk goes whatever its id or language; one id's rows, or those without an id, are judged each on its own, in more than one block."""
    r = random.Random(8)
    words = ["the", "cat", "sat", "on", "mat", "and", "ran"]
    text = lambda: " ".join(r.choice(words) for _ in range(40))
    rows = [(i, text(), "en") for i in range(200)]
    odd = [(None, text(), "en") for i in range(800)] + [(7777, text(), "en") for i in range(800)] + [(8000 + i, text(), None) for i in range(50)]
    junk = [(None, "%$ #@! ^&* ~~ " * 20, "en"), (7777, "%$ #@! ^&* ~~ " * 20, "en"), (9000, "%$ #@! ^&* ~~ " * 20, None)]
    docs = spark.createDataFrame(rows + odd + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, block_bytes=20_000).toPandas()
    assert not kept.text.str.contains("#@!").any() and kept.columns.tolist() == docs.columns
    assert kept.doc_id.isna().sum() > 700 and (kept.doc_id == 7777).sum() > 700 and kept.lang.isna().sum() > 40
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    dealt, hot, blocks = quality._in_blocks(texts, 20_000)
    sizes = {x["block"]: x["n"] for x in dealt.filter("__id IS NULL OR __id = 7777").groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert [x[0] for x in hot.collect()] == [7777] and len(sizes) == blocks > 10 and max(sizes.values()) < 3 * 1602 / blocks
    one = quality.judge(docs, labels, block_bytes=20_000).toPandas()
    other = quality.judge(docs, labels).toPandas()
    assert sorted(zip(one.n_bytes, one.perplexity.round(9))) == sorted(zip(other.n_bytes, other.perplexity.round(9)))


def test_quality_packs_texts_once(spark):
    """Texts are read for their sizes and packed once; both passes read the packs without a shuffle, and nothing of them stays."""
    r = random.Random(18)
    words = ["the", "cat", "sat", "on", "mat", "and", "ran"]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(40)), "en") for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    read, before = spark.sparkContext.accumulator(0), len(spark.catalog.listTables())

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    assert quality.judge(docs.mapInArrow(count, docs.schema), labels, block_bytes=5000).filter("keep").count() > 250
    assert 300 < read.value <= 600 and len(spark.catalog.listTables()) == before
    packs = quality._kept(quality._packed(docs.selectExpr("doc_id % 9 AS block", "doc_id AS __id", "1L AS __own", "lang AS __lang", "text AS __text")), 9, "packs_of_a_test")
    try:
        plan = quality._block_counts(packs, docs.selectExpr("doc_id AS __t", "doc_id % 9 AS block"))
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(block") == 1
    finally:
        spark.sql("DROP TABLE packs_of_a_test")


def test_quality_of_many_and_untaught_languages(spark):
    """Hundreds of languages are modelled each; junk goes in a language without trusted text too, and its plain text stays."""
    r = random.Random(6)
    words = ["the", "cat", "sat", "on", "mat", "and", "ran"]
    text = lambda: " ".join(r.choice(words) for _ in range(30))
    rows = [(k, text(), f"l{k % 600}") for k in range(2400)] + [(5000 + k, text(), "sv") for k in range(30)]
    junk = [(6000, "%$ #@! ^&* ~~ " * 20, "sv"), (6001, "%$ #@! ^&* ~~ " * 20, "l599"), (6002, "%$ #@! ^&* ~~ " * 20, None)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in quality.judge(docs, spark.createDataFrame([(k, 1) for k in range(2400)], "doc_id long, quality int")).collect()}
    assert not any(got[k]["keep"] for k in (6000, 6001, 6002)) and all(got[k]["perplexity"] for k in got)
    assert sum(got[5000 + k]["keep"] for k in range(30)) > 25 and sum(got[k]["keep"] for k in range(2400)) > 2200
    assert {x["lang"] for x in got.values()} >= {"l599", "sv", None}


def test_no_language_is_lost_behind_a_long_text(spark):
    words = {"en": ["the", "cat", "sat", "on"], "de": ["der", "hund", "und", "ich"], "xx": ["qq", "zz", "ww", "vv"]}
    r = random.Random(2)
    rows = [(k, lang, " ".join(r.choices(words[lang], k=40))) for lang in ("en", "de") for k in range(100 * (lang == "de"), 100 * (lang == "de") + 60)]
    own = lambda df: df.select("doc_id", F.xxhash64(F.lit("lid"), F.col("doc_id")).alias("h"))
    first = min(own(spark.createDataFrame(rows, "doc_id long, lang string, text string").filter("lang = 'de'")).collect(), key=lambda x: x["h"])["doc_id"]
    long = " ".join(words["de"]) * 20000
    rows = [(k, lang, long if k == first else text) for k, lang, text in rows] + [(900, "xx", "qq zz ww vv " * 20000)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), sample_bytes=60_000)
    assert net.languages == ["de", "en", "xx"]
    asked = spark.createDataFrame([(1, "the cat sat on the cat and sat"), (2, "und ich der hund und der hund")], "doc_id long, text string")
    assert [x["lang_pred"] for x in language.predict(asked, net).orderBy("doc_id").collect()] == ["en", "de"]


def test_license_templates(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0."
    scattered = [w for _, t in licenses.TEMPLATES for w in t.split()]
    cases = [
        (mit, "mit"), (mit.replace(" documentation", ""), "mit"), ("permission is granted to any person", ""), ("Licensed, under: CC-BY-NC 4.0", "cc-by-nc"), ("x\nlicensed under\ncc by nc 4 0", "cc-by-nc"),
        (bsd, "bsd"), (mpl, "mpl"), ("w " * 5000 + bsd + " w" * 5000, "bsd"), (" ".join(f"{w} " + "far away from it " * 12 for w in scattered), ""),
        ("released under the other license", ""), ("Licensed under CC BY 4.0", ""),
    ]
    for k in range(40):  # at any place of a window
        cases += [("w " * k + text + " w" * k, label) for text, label in ((mit, "mit"), (bsd, "bsd"), (mpl, "mpl"))]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == [label for _, label in cases] and all(r["n_base"] == 0 for r in got)
    assert got[1]["score"] == 18 / 19 and [p["label"] for p in got[0]["places"]] == ["mit"]


def linked_plainly(prints):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & simhash.ALL).bit_count() <= 3:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in prints}


@pytest.mark.parametrize("meet", [2048, 3])
def test_links_of_planted_fingerprints(spark, meet):
    r = random.Random(meet)
    prints = {0}
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            prints.add(f)
            for _ in range(r.randrange(5)):
                f ^= 1 << r.randrange(64)
    prints = sorted(simhash._signed(f) for f in prints)
    got = {r["node"]: r["root"] for r in simhash.linked(spark.createDataFrame([(f,) for f in prints], "fp long"), meet=meet).collect()}
    assert {f: got.get(f, f) for f in prints} == linked_plainly(prints)


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_balls_meet(spark, parts):
    r = random.Random(parts)
    pairs = []
    for d in (1, 2, 3):
        for _ in range(20):
            f = r.getrandbits(64)
            pairs.append((simhash._signed(f), simhash._signed(f ^ sum(1 << b for b in r.sample(range(64), d)))))
    df = spark.createDataFrame(pairs, "a long, b long")
    at = lambda c: simhash.variants(df.select(F.col(c).alias("fp")), parts).withColumnRenamed("fp", c)
    assert df.join(at("a").join(at("b"), "meet"), ["a", "b"], "left_semi").count() == len(pairs)


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(n, n) == root[n] for n in root)


def test_simhash(spark, local):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))] if words else []
        return simhash._signed(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))

    prints = {r.doc_id: fingerprint(r.text) for r in local.itertuples()}
    root, least = linked_plainly(sorted(set(prints.values()))), {}
    for i, f in sorted(prints.items()):
        least.setdefault(root[f], i)
    for r in queries.QUERIES["op8_simhash"](spark, SF).collect():
        assert r["fingerprint"] == "%016x" % (prints[r["doc_id"]] & simhash.ALL) and r["component_id"] == least[root[prints[r["doc_id"]]]]


def test_urls_learn_rules(spark):
    got = queries.QUERIES["op10_url_filter"](spark, "/root/testdata/sf0.01").toPandas()
    assert set(got.verdict) == {"allow", "block"} and got.rule.isna().any()
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas().set_index("page_id")
    for r in got.itertuples():
        rest = pages.url[r.page_id].partition("://")[2]
        assert r.host == re.split("[/?#]", rest)[0].lower() and r.path == re.split("[?#]", rest[len(r.host) :])[0]
        fit = [x for _, x in url_filter.RULES if (r.host == x.split("/")[0] or r.host.endswith("." + x.split("/")[0])) and r.path.startswith(x[x.index("/") :])]
        assert (r.rule or None) == (max(fit, key=len) if fit else None) if isinstance(r.rule, str) or fit else True


def test_url_classifier_is_plain_logistic_regression(spark):
    """Features and scores against n-grams and Newton steps in numpy."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(3, 8)))
    rows = [(i, f"http://{word()}.{'bad' if i % 3 else 'good'}{word()}.com/{word()}/{'win' if i % 2 else 'read'}{word()}", i % 3 > 0) for i in range(300)]
    labelled = spark.createDataFrame([(u, int(y)) for _, u, y in rows[:200]], "url string, label int")
    urls = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    made = url_filter.with_features(url_filter.with_parts(urls)).orderBy("page_id").collect()
    sets = []
    for row, (_, url, _) in zip(made, rows):
        host, _, path = url.partition("://")[2].partition("/")
        grams = {mark + f"<{t}>"[i : i + n] for mark, t in (("h", host), ("p", "/" + path)) for n in url_filter.SIZES for i in range(len(t) + 3 - n)}
        index = {url_filter.HashingTF(numFeatures=url_filter.FEATURES).indexOf(g) for g in grams} if len(sets) < 5 else set(row["__features"].indices.tolist())
        assert set(row["__features"].indices.tolist()) == index and len(index) > len(grams) - 4
        sets.append(sorted(index))
    used = sorted({i for s in sets for i in s})
    x = np.array([[1.0] + [float(i in set(s)) for i in used] for s in sets])
    y, w, keep = np.array([float(v) for *_, v in rows[:200]]), np.zeros(len(used) + 1), np.r_[0, np.full(len(used), 0.01)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-x[:200] @ w))
        w -= np.linalg.solve((x[:200] * (p * (1 - p))[:, None]).T @ x[:200] / 200 + np.diag(keep + 1e-9), x[:200].T @ (p - y) / 200 + keep * w)
    want = 1 / (1 + np.exp(-x @ w))
    got = [s["block_score"] for s in url_filter.judge(urls, labelled, rules=(("block", "nowhere/"),)).orderBy("page_id").collect()]
    assert np.abs(np.array(got) - want).max() < 0.02 and (want[200:] > 0.5).mean() == np.mean([s > 0.5 for s in got[200:]])


def test_url_sample_is_bounded_and_balanced(spark):
    """A rare label is learned too, and a URL that stands in most rows counts once."""
    rows = [(i, "http://a.net/same") for i in range(2000)] + [(3000 + i, f"http://b{i}.net/x") for i in range(3000)] + [(9000 + i, f"http://c.org/fr/{i}") for i in range(5)] + [(9999, "http://c.org/fx/9")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), n_labelled=40).collect()
    assert {r["verdict"] for r in got if r["rule"] == "org/fr/"} == {"allow"} and [r["block_score"] < 0.5 for r in got if r["page_id"] == 9999] == [True]
