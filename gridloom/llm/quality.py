"""Quality classifier: an interpolated modified Kneser-Ney model of byte 4-grams.

The model of a language is trained on its trusted texts, all of them but one in ``HOLD_OUT``. A text's perplexity under
it, per byte, is compared with a quantile of that of the trusted texts held out, times ``MARGIN``. Quantile
and margin were chosen on labelled texts: with the 0.95 quantile texts whose language is
labelled wrongly don't move a threshold, and with 1.08 times that most texts of repeated words go too, whose bytes
are likelier than other junk's, while about one in a hundred clean texts is lost (README).

The work is laid out so that texts move little and n-grams less:

1. documents are dealt into blocks by the hash of their id (of id and text where there is no id, or where one id has
   more than a block's bytes), and written compressed, once, to a table in buckets of blocks, which both passes over
   texts read without a shuffle and which is dropped after them; each block
   counts its trusted n-grams and lists the distinct ones of all its texts (packed arrays);
2. counts are summed over blocks, sharded by language and n-gram; continuation counts, discounts
   and back-off weights of all orders follow from them by grouping and joining those shards;
   every distinct n-gram of the corpus gets its log-probability by joins of those shards;
3. blocks get the log-probabilities of the n-grams they listed, and add them up for each text.

An n-gram is counted once in each block and joined once in all, however often it stands in texts.
Nothing of it passes through the driver but the numbers of blocks and languages and the greatest mean and threshold;
discounts, means and thresholds are tables of a row a language, broadcast if there are few. A task holds one block (about
``BLOCK_BYTES``) and its n-grams.

Texts without a language, or of a language without trusted text, are judged by a model of all languages' trusted texts (their counts, summed) with
the greatest mean and threshold of any language, times ``POOLED_MARGIN``. So are the mean and threshold of a language
with fewer than ``LEAST_HELD_OUT`` trusted texts held out.

Perplexities of short texts scatter: the mean log-probability is drawn towards the language's
mean as if ``PRIOR`` more bytes of typical text had been seen.

Defined results: null and empty texts have null perplexity and are rejected; texts without a language, or of an untaught one,
see above; if there is no trusted text, or none held out, nothing can be judged and all other texts are kept, with null perplexity or threshold; ids that are labelled twice are trusted only if all labels say so; repeated rows get
equal results; an empty table gives an empty result. Other columns are ignored by ``judge`` and carried
along by ``keep_good``.
"""

from __future__ import annotations

import io
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, shuffle_partitions, table
from .samples import fold

ORDER, BLOCK_BYTES, PRIOR, QUANTILE, MARGIN, HOLD_OUT = 4, 12 << 20, 60, 0.95, 1.08, 5
LEAST_HELD_OUT, POOLED_MARGIN = 10, 1.25
FEW = 100_000  # ids with more than a block's bytes, or languages, that are broadcast
FEW_MODELS = {1: 5000, 2: 30}  # languages whose models of the lowest orders, some 4 KB a context, are broadcast: 20 and 30 MB
NO_LANGUAGE = "\u0001"  # stands for null inside
BEFORE = b"\xff" * (ORDER - 1)  # stands before every text; UTF-8 has no such byte


def _packed(docs: DataFrame) -> DataFrame:
    """docs (block, __id, __own, __lang, __text) as compressed packs (block, pack)."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            number = np.asarray(batch.column(0))
            rows = batch.select(["__id", "__own", "__lang", "__text"])
            found = []
            for block in np.unique(number):
                sink = io.BytesIO()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows.take(pa.array(np.flatnonzero(number == block))))
                found.append((int(block), squeeze.compress(sink.getvalue())))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["block", "pack"])

    return docs.select("block", "__id", "__own", "__lang", "__text").mapInArrow(run, "block long, pack binary")


def _kept(packs: DataFrame, blocks: int, name: str) -> DataFrame:
    """packs as a table of that name, in buckets by block: each of the tasks, no more than there are blocks, writes to each bucket."""
    buckets = min(blocks, max(64, shuffle_partitions(packs.sparkSession)))
    plain = packs.write.format("parquet").option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
    plain.bucketBy(buckets, "block").saveAsTable(name)
    return packs.sparkSession.table(name)


def _unpacked(packs: pa.Table):
    """(ids, own numbers, languages, texts as bytes) of each pack of a block."""
    expand = zstandard.ZstdDecompressor()
    for pack in packs.column("pack"):
        rows = pa.ipc.open_stream(expand.decompress(pack.as_py())).read_all()
        yield rows.column(0), rows.column(1), rows.column(2).to_pylist(), [(t or "").encode() for t in rows.column(3).to_pylist()]


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each byte of each text, and the number of bytes of each text."""
    data = np.frombuffer(b"".join(BEFORE + t for t in texts), np.uint8).astype(np.uint32)
    key = np.zeros(max(0, len(data) - ORDER + 1), np.uint32)
    for i in range(ORDER):
        key |= data[i : len(data) - ORDER + 1 + i] << np.uint32(8 * (ORDER - 1 - i))
    return key[(key & np.uint32(255)) != 255], np.array([len(t) for t in texts], np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def _block_counts(packs: DataFrame, trusted: DataFrame) -> DataFrame:
    """block, lang, keys, counts: the distinct n-grams of a block's texts in a language, and how
    often each stands in the trusted ones (packed arrays)."""

    def run(left, right):
        good = set(right.column("__t").to_pylist())
        held: dict = {}
        for ids, _, langs, texts in _unpacked(left):
            ids = ids.to_pylist()
            for lang in set(langs):
                for use in (0, 1):
                    part = [t for t, l, i in zip(texts, langs, ids) if l == lang and t and (i in good) == use]
                    if part:
                        keys, counts = np.unique(ngrams(part)[0], return_counts=True)
                        held.setdefault(lang, []).append((keys, counts * use))
            held = {lang: [_merged(p)] if len(p) > 24 else p for lang, p in held.items()}
        found = [(lang, *_merged(p)) for lang, p in held.items()]
        block = left.column("block")[0].as_py() if left.num_rows else 0
        held.clear()
        give_back()
        return pa.table([pa.array([block] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1].astype("<u4").tobytes() for f in found], pa.binary()), pa.array([f[2].astype("<i8").tobytes() for f in found], pa.binary())], ["block", "lang", "keys", "counts"])

    return packs.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(run, "block long, lang string, keys binary, counts binary")


def _listed(counted: DataFrame) -> DataFrame:
    """block, lang, key, count: a row for each n-gram of each block."""

    def run(batches):
        for batch in batches:
            for block, lang, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                key = np.frombuffer(keys, "<u4").astype(np.int64)
                for i in range(0, len(key), 50_000):
                    part = key[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(np.frombuffer(counts, "<i8")[i : i + 50_000])], ["block", "lang", "key", "n"])

    return counted.mapInArrow(run, "block long, lang string, key long, n long")


def _discounts(levels: dict[int, DataFrame]) -> DataFrame:
    """order, d_lang, off: for each order and language what is taken off counts of 1, 2 and more, from the numbers of
    n-grams seen once to four times."""
    every = reduce(DataFrame.unionByName, [c.select(F.lit(order).alias("order"), "lang", "n") for order, c in levels.items()])
    seen = every.groupBy("order", F.col("lang").alias("d_lang")).agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def off(k, default):
        a, b = F.col(f"n{k}"), F.col(f"n{k + 1}")
        return F.when((a > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * b / a))).otherwise(F.lit(default))

    return cut(seen.select("order", "d_lang", F.array(off(1, 0.6), off(2, 1.1), off(3, 1.5)).alias("off")))


def _small(rows: DataFrame, number: int, most: int = FEW) -> DataFrame:
    return F.broadcast(rows) if number <= most else rows


def _low(key: Column, order: int) -> Column:
    return key.bitwiseAND(F.lit((1 << (8 * order)) - 1).cast("long"))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """counts (lang, key, n: trusted count, may be 0) to lang, key, logp of the last byte given
    those before it. N-grams of a language without any count are left out."""
    seen = counts.filter("n > 0")
    levels = {ORDER: seen}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: different bytes seen before
        levels[order] = levels[order + 1].groupBy("lang", _low(F.col("key"), order).alias("key")).agg(F.count("*").alias("n"))
    discounts = _discounts(levels)
    languages = discounts.filter(F.col("order") == ORDER).count()
    taught = _small(discounts.filter(F.col("order") == ORDER).select("d_lang"), languages)
    asked = counts.join(taught, F.col("lang") == F.col("d_lang"), "left_semi").select("lang", "key", F.lit(1 / 256).alias("p"))
    for order in range(1, ORDER + 1):
        byte = F.col("key").bitwiseAND(F.lit(255).cast("long"))
        own = _small(discounts.filter(F.col("order") == order).drop("order"), languages)
        # a row for each context: at most 256 bytes follow
        model = (
            levels[order]
            .join(own, F.col("lang") == F.col("d_lang"))
            .withColumn("off", F.element_at("off", F.least(F.col("n"), F.lit(3)).cast("int")))
            .groupBy(F.col("lang").alias("m_lang"), F.shiftright("key", 8).alias("context"))
            .agg(F.sum("n").alias("total"), F.sum("off").alias("offs"), F.map_from_entries(F.collect_list(F.struct(byte, F.col("n") - F.col("off")))).alias("own"))
        )
        model = _small(model, languages, FEW_MODELS.get(order, -1))
        here = (F.col("lang") == F.col("m_lang")) & (F.shiftright(_low(F.col("key"), order), 8) == F.col("context"))
        share = F.coalesce(F.try_element_at("own", byte), F.lit(0.0)) / F.col("total") + F.col("offs") / F.col("total") * F.col("p")
        asked = asked.join(model, here, "left").select("lang", "key", F.coalesce(share, F.col("p")).alias("p"))
    return asked.select("lang", "key", F.log("p").alias("logp"))


def _text_sums(packs: DataFrame, chances: DataFrame, id_type: str) -> DataFrame:
    """__id, __own, lang, n_bytes, logp (null if the language has no model): a row for each text."""

    def run(left, right):
        model: dict = {}
        langs, keys, logs = np.array(right.column("lang").to_pylist(), object), right.column("key").to_numpy(), right.column("logp").to_numpy()
        for lang in set(langs.tolist()):
            rows = np.flatnonzero(langs == lang)
            order = rows[np.argsort(keys[rows])]
            model[lang] = keys[order].astype(np.uint32), logs[order]
        parts = []
        for ids, own, names, texts in _unpacked(left):
            size, total = np.array([len(t) for t in texts], np.int64), np.full(len(texts), np.nan)
            judge = [l if l in model else NO_LANGUAGE for l in names]
            for lang in set(judge) & set(model):
                rows = np.array([i for i, l in enumerate(judge) if l == lang and size[i]], np.int64)
                if len(rows):
                    key, n = ngrams([texts[i] for i in rows])
                    known, chance = model[lang]
                    total[rows] = np.add.reduceat(chance[np.searchsorted(known, key)], np.cumsum(n) - n)
            parts.append(pa.table([ids, own, pa.array(names, pa.string()), pa.array(size), pa.array(total, from_pandas=True)], ["__id", "__own", "lang", "n_bytes", "logp"]))
        model.clear()
        give_back()
        return pa.concat_tables(parts) if parts else pa.table([left.column(0).slice(0, 0).cast(id_arrow), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["__id", "__own", "lang", "n_bytes", "logp"])

    id_arrow = pa.string() if id_type == "string" else pa.int64()
    return packs.groupBy("block").cogroup(chances.groupBy("block")).applyInArrow(run, f"__id {id_type}, __own long, lang string, n_bytes long, logp double")


def _pooled(counts: DataFrame) -> DataFrame:
    """counts with those of all languages' trusted texts for NO_LANGUAGE, if there are texts of it; it has none of its own."""
    own = counts.filter(F.col("lang") == NO_LANGUAGE)
    if own.isEmpty():
        return counts
    every = counts.filter("n > 0").groupBy("key").agg(F.sum("n").alias("n")).select(F.lit(NO_LANGUAGE).alias("lang"), "key", "n")
    pooled = own.unionByName(every).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("lang") != NO_LANGUAGE).unionByName(pooled)


def _judged_as(rows: DataFrame, taught: DataFrame) -> DataFrame:
    """rows (lang, ...) with NO_LANGUAGE for languages that aren't in taught (t_lang)."""
    return rows.join(taught, F.col("lang") == F.col("t_lang"), "left").withColumn("lang", F.coalesce("t_lang", F.lit(NO_LANGUAGE))).drop("t_lang")


def _limits(trusted: DataFrame, quantile: float, margin: float) -> tuple[DataFrame, float | None, float | None]:
    """From the held-out trusted texts (lang, n_bytes, logp): l_lang, mean, limit of each language with enough of them, and the greatest of both for the others."""
    stats = cut(trusted.groupBy(F.col("lang").alias("l_lang")).agg((-F.sum("logp") / F.sum("n_bytes")).alias("mean"), F.count("*").alias("texts")))
    enough = (stats.agg(F.max("texts")).first()[0] or 0) >= LEAST_HELD_OUT
    known = stats.filter(F.col("texts") >= (LEAST_HELD_OUT if enough else 0))
    top = known.agg(F.max("mean")).first()[0]
    languages = known.count()
    drawn = _drawn(trusted.join(_small(known, languages), F.col("lang") == F.col("l_lang")), F.col("mean"))
    limits = cut(drawn.groupBy("l_lang").agg(F.first("mean").alias("mean"), (F.percentile_approx("perplexity", quantile, 10000) * margin).alias("limit")))
    most = limits.agg(F.max("limit")).first()[0]
    return _small(limits, languages), top, None if most is None else most * POOLED_MARGIN


def _drawn(sums: DataFrame, mean: Column) -> DataFrame:
    return sums.withColumn("perplexity", F.exp((-F.col("logp") + PRIOR * mean) / (F.col("n_bytes") + PRIOR)))


def _in_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """docs with block; ids with more than a block's bytes (__hot), whose rows are dealt over all blocks; the number of
    blocks, which follows from the size alone: small ones would list common n-grams again and again."""
    sizes = cut(docs.groupBy("__id").agg(F.sum(F.octet_length("__text")).alias("bytes")))
    blocks = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    hot = sizes.filter((F.col("bytes") > block_bytes) & F.col("__id").isNotNull()).select(F.col("__id").alias("__hot"))
    n_hot = hot.count()
    spread = F.col("__id").isNull()
    if n_hot:
        docs = docs.join(F.broadcast(hot) if n_hot <= FEW else hot, F.col("__id") == F.col("__hot"), "left")
        spread = spread | F.col("__hot").isNotNull()
    number = F.pmod(F.when(spread, F.xxhash64("__id", "__text")).otherwise(F.xxhash64("__id")), F.lit(blocks))
    return docs.withColumn("block", number).drop("__hot"), hot, blocks


def _sums(packs: DataFrame, trusted: DataFrame, hot: DataFrame, blocks: int, id_type: str) -> DataFrame:
    """What ``_text_sums`` gives for the texts of packs, by models of the trusted ids' (__t) texts."""
    places = F.when(F.col("__hot").isNull(), F.array(F.pmod(F.xxhash64("__t"), F.lit(blocks)))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    taught = trusted.join(hot, F.col("__t") == F.col("__hot"), "left").select("__t", F.explode(places).alias("block"))
    counted = cut(_block_counts(packs, taught))
    listed = _listed(counted)
    summed = cut(listed.groupBy("lang", "key").agg(F.sum("n").alias("n")))
    taught = cut(summed.filter("n > 0").select(F.col("lang").alias("t_lang")).distinct())
    taught = _small(taught, taught.count())
    untaught = summed.join(taught, F.col("lang") == F.col("t_lang"), "left_anti")
    if not untaught.filter(F.col("lang") != NO_LANGUAGE).isEmpty():
        others = _judged_as(untaught, taught).groupBy("lang", "key").agg(F.sum("n").alias("n"))
        summed = summed.join(taught, F.col("lang") == F.col("t_lang"), "left_semi").unionByName(others)
        listed = _judged_as(listed.select("block", "lang", "key"), taught)
    chances = cut(log_probabilities(_pooled(summed)))
    found = chances.withColumnsRenamed({"lang": "c_lang", "key": "c_key"})
    in_blocks = listed.join(found, (listed["lang"] == found["c_lang"]) & (listed["key"] == found["c_key"])).select("block", "lang", "key", "logp")
    return cut(_text_sums(packs, in_blocks, id_type))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang: str, quantile: float, margin: float, block_bytes: int) -> DataFrame:
    """__id, __own, lang, n_bytes, perplexity, threshold, keep: a row for each row of docs."""
    docs = docs.select(F.col(id_col).alias("__id"), _own(id_col, text_col, lang).alias("__own"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("__lang"), F.col(text_col).alias("__text"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).cast(docs.schema["__id"].dataType).alias("__t")).agg(F.min("quality").alias("q")).filter("q = 1").drop("q")
    held_out = fold(F.col("__t"), HOLD_OUT) == 0
    dealt, hot, blocks = _in_blocks(docs, block_bytes)
    name = f"quality_{uuid.uuid4().hex}"
    try:
        packs = _kept(_packed(dealt.coalesce(blocks)), blocks, name)
        sums = _sums(packs, known.filter(~held_out), hot, blocks, docs.schema["__id"].dataType.simpleString())
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    limits, top, most = _limits(sums.filter(f"logp IS NOT NULL AND lang <> '{NO_LANGUAGE}'").join(known.filter(held_out), F.col("__id") == F.col("__t"), "left_semi"), quantile, margin)
    mean, limit = F.coalesce("mean", F.lit(top).cast("double")), F.coalesce("limit", F.lit(most).cast("double"))
    judged = _drawn(sums.join(limits, F.col("lang") == F.col("l_lang"), "left"), mean).withColumn("threshold", F.when(F.col("logp").isNotNull(), limit)).drop("l_lang", "mean", "limit")
    return judged.withColumn("keep", (F.col("n_bytes") > 0) & (F.col("perplexity").isNull() | (F.col("perplexity") <= F.col("threshold"))))


def _own(id_col: str, text_col: str, lang: str) -> Column:
    """A number of what a row is judged by."""
    return F.xxhash64(F.col(id_col), F.col(id_col).isNull(), F.col(lang), F.col(lang).isNull(), F.col(text_col))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, lang, n_bytes, perplexity, threshold, keep: a row for each row of docs. labels has the
    columns id and quality; quality 1 is trusted."""
    judged = _judged(docs, labels, id_col, text_col, lang, quantile, margin, block_bytes)
    return judged.select(F.col("__id").alias(id_col), F.when(F.col("lang") != NO_LANGUAGE, F.col("lang")).alias("lang"), "n_bytes", "perplexity", "threshold", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that ``judge`` keeps."""
    judged = _judged(docs, labels, id_col, text_col, lang, quantile, margin, block_bytes)
    kept = judged.filter("keep").select(F.col("__own").alias("__kept")).distinct()
    return docs.withColumn("__row", _own(id_col, text_col, lang)).join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
