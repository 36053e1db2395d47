"""Mixing sources to target weights, in SQL expressions only.

Each source's tokens are summed once (partial sums on the map side, so that a hot source costs
no more than a cold one). The sums give a token target and with it a repetition rate for each
source; a document is then emitted floor(rate) times, plus once more if the hash of its id,
read as a number in [0, 1), falls below a threshold: the fraction of the rate, calibrated.

Independent draws over unequal documents would scatter around the target. So the draws of a
source are coupled by a common threshold: the place in its hash order at which the words drawn
come nearest to fraction * source size. By the hash that place is the fraction, but for chance,
and so is a document's probability in a source of many documents; in one of few it isn't, as the draw that comes nearest is
taken (a source's only document is rounded, not drawn). A source then misses its target by half the
words of one document at most (or of documents whose draws agree in ``2 * BITS`` bits). Where it comes nearer
still, the document at the threshold gives way to one range of later draws, in a small source another document.
The place is found in two steps of ``BITS`` bits, with sums of 2^BITS ranges a source each, the second within the range that the first
one points to: no task sees a source's documents, however many there are. The draw depends on the seed and
the id alone, the threshold on the table: reruns, retries and any partitioning agree.

Targets: sources share all tokens by weight, but none gets more than ``max_repeats`` times its
own size; what is cut off goes to the others by weight, until none is above. That is
``min(max_repeats * size, level * weight)`` with one ``level`` for all, which running sums over
the sources in order of size / weight find without a loop.

Defined results: a null text has size 0 and is emitted like any other of its source; a null
source is a source of its own, last in order; sources without tokens have target and rate 0 and
emit nothing; rows with equal ids draw alike, rows without an id by their text; an empty table gives an empty mix. Other columns
are carried along; columns named like those this operator adds (``size``, ``source_size``,
``target``, ``rate``, ``copies``, ``taken``) are replaced.

The table of sources (a row for each) is ordered in one task: it must fit there, which holds for
sources that people name. It is written once and counted: up to ``FEW`` sources are broadcast, so that
texts are not shuffled; more are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MAX_REPEATS, SEED = (5, 2, 1), 3, "mix-1"
FEW = 50_000  # sources, of a few dozen bytes each, that are broadcast
BITS = 10  # of a draw that a step of the search for a threshold looks at
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, source: str = "source") -> DataFrame:
    """A row for each source: __source, source_size, target, rate. ``sized`` has the columns
    source and size. Weights repeat over the sources in order of code points, null last."""
    per = sized.groupBy(F.col(source).alias("__source")).agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__n") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_fill = Window.orderBy(F.col("__cap") / F.col("__weight"), "__n").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        per.withColumn("__n", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
        .withColumn("__weight", weight.cast("long"))
        .withColumn("__cap", F.col("source_size") * max_repeats)
        .withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__all_weight", F.sum("__weight").over(everything))
        .withColumn("__caps", F.sum("__cap").over(by_fill) - F.col("__cap"))
        .withColumn("__weights", F.sum("__weight").over(by_fill) - F.col("__weight"))
        # the level if this source and all after it were uncapped: it rises up to the first that is, then falls
        .withColumn("__level", (F.col("__total") - F.col("__caps")).cast("double") / (F.col("__all_weight") - F.col("__weights")).cast("double"))
        .withColumn("__level", F.max("__level").over(everything))
    )
    capped = F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__weight"))
    return ranked.select("__source", "source_size", capped.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw_of(name: Column, text: Column, seed: str = SEED) -> Column:
    """The hash of an id, or of the text where there is none, as a whole number of 2 * BITS bits."""
    own = F.coalesce(name.cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))))
    return F.shiftright(F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), own)), 1, 12), 16, 10).cast("long"), 48 - 2 * BITS)


def _reached(sums: DataFrame, wanted: Column) -> DataFrame:
    """sums (__source, __range, __words, ...) to the row of each source at which the running sum of words
    reaches ``wanted``, with __before, the words of the ranges before it."""
    upto = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("__upto", F.sum("__words").over(upto)).withColumn("__before", F.col("__upto") - F.col("__words"))
    return run.filter((wanted > 0) & (F.col("__upto") >= wanted) & (F.col("__before") < wanted))


def with_copies(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source: str = "source") -> DataFrame:
    """docs with size, source_size, target, rate, copies (times to emit) and taken (copies * size)."""
    sized = docs.drop(*(c for c in ADDED if c not in (id_col, text_col, source)))
    draw, size = draw_of(F.col(id_col), F.col(text_col), seed), n_words(F.col(text_col))
    ranges = cut(sized.groupBy(F.col(source).alias("__source"), F.shiftright(draw, BITS).alias("__range")).agg(F.sum(size).alias("__words")))
    targets = cut(source_targets(ranges.withColumnRenamed("__words", "size"), weights, max_repeats, "__source"))
    few = targets.limit(FEW + 1).count() <= FEW
    by_source = lambda df: (lambda other: df.join(F.broadcast(other) if few else other, df["__source"].eqNullSafe(other["__s"]), "left").drop("__s"))
    extra = (F.col("rate") - F.floor("rate")) * F.col("source_size")
    wanted = targets.select(F.col("__source").alias("__s"), extra.alias("__wanted"))
    first = cut(_reached(by_source(ranges)(wanted), F.col("__wanted")).select(F.col("__source").alias("__s"), F.col("__range").alias("__first"), F.col("__before").alias("__b"), "__wanted"))
    marked = sized.select(F.col(source).alias("__source"), draw.alias("__draw"), F.col(text_col).alias("__text"))
    inside = by_source(marked)(first).filter(F.shiftright("__draw", BITS) == F.col("__first"))
    fine = inside.groupBy("__source", F.col("__draw").alias("__range"), "__b", "__wanted").agg(F.sum(n_words(F.col("__text"))).alias("__words"))
    found = _reached(fine.withColumn("__wanted", F.col("__wanted") - F.col("__b")), F.col("__wanted"))
    gap, words = F.col("__wanted") - F.col("__before"), F.col("__words")
    found = cut(found.select(F.col("__source").alias("__s"), F.shiftright("__range", BITS).alias("__at"), F.col("__range").alias("__limit"), gap.alias("__gap"), F.abs(words - gap).alias("__miss")))
    later = by_source(ranges)(found).filter(F.col("__range") > F.col("__at")).groupBy("__source").agg(F.min(F.struct(F.abs(words - F.col("__gap")).alias("miss"), F.col("__range").alias("range"))).alias("__later"))
    chosen = by_source(found.withColumnRenamed("__s", "__source"))(later.withColumnRenamed("__source", "__s"))
    other = (F.col("__later.miss") < F.col("__miss")) & (F.col("__later.miss") < F.col("__gap"))
    take = ~F.coalesce(other, F.lit(False)) & (F.col("__miss") <= F.col("__gap"))
    limits = chosen.select(F.col("__source").alias("__s"), (F.col("__limit") + take.cast("int")).alias("__limit"), F.when(other, F.col("__later.range")).alias("__also"))
    known = cut(by_source(targets)(limits)).withColumnRenamed("__source", "__s")
    whole = F.floor("rate")
    return (
        by_source(sized.withColumn("size", size).withColumn("__source", F.col(source)))(known)
        .withColumn("copies", F.least(whole + F.when((draw < F.col("__limit")) | (F.shiftright(draw, BITS) == F.col("__also")), 1).otherwise(0), F.lit(max_repeats)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("__source", "__limit", "__also")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs alone."""
    out = with_copies(docs, **options).filter("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM per),
weighed AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM numbered),
filled AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS all_w,
    (sum(cap) OVER f)::BIGINT - cap AS caps, (sum(w) OVER f)::BIGINT - w AS ws
  FROM weighed WINDOW f AS (ORDER BY cap / w, n ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, (total - caps)::DOUBLE / (all_w - ws)::DOUBLE AS lev FROM filled),
level AS (SELECT max(lev) AS lev FROM levels),
targets AS (
  SELECT l.source, l.source_size, least(l.cap::DOUBLE, level.lev * l.w) AS target FROM levels l, level),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
drawn AS (
  SELECT doc_id, source, size, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(md5(text), ''))), 1, 12))::BIGINT >> 28 AS draw FROM sized),
sums AS (SELECT source, draw, sum(size)::BIGINT AS words FROM drawn GROUP BY source, draw),
summed AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY draw))::BIGINT AS upto FROM sums),
crossed AS (
  SELECT s.source, s.draw, wanted - (upto - words) AS gap, abs(words - (wanted - (upto - words))) AS miss
  FROM summed s JOIN (SELECT source, (rate - floor(rate)) * source_size AS wanted FROM rated) r ON s.source IS NOT DISTINCT FROM r.source
  WHERE wanted > 0 AND upto >= wanted AND upto - words < wanted),
ranges AS (SELECT source, draw >> 10 AS r, sum(words)::BIGINT AS words FROM sums GROUP BY ALL),
later AS (
  SELECT * FROM (SELECT r.source, r.r, abs(r.words - c.gap) AS lmiss, row_number() OVER (PARTITION BY r.source ORDER BY abs(r.words - c.gap), r.r) AS k
    FROM ranges r JOIN crossed c ON r.source IS NOT DISTINCT FROM c.source AND r.r > c.draw >> 10) WHERE k = 1),
chosen AS (SELECT c.*, l.r, coalesce(lmiss < miss AND lmiss < gap, false) AS other FROM crossed c LEFT JOIN later l ON c.source IS NOT DISTINCT FROM l.source),
copied AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
    least(floor(rate) + coalesce(d.draw < c.draw + (NOT other AND miss <= gap)::INT OR (other AND d.draw >> 10 = c.r), false)::INT, 3)::BIGINT AS copies
  FROM drawn d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
"""
