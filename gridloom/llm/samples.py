"""Bounded samples of labelled rows, on which models are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FEW = 10_000  # labels whose counts, some bytes each, are broadcast


def fold(name: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(name.cast("string").cast("binary")), F.lit(folds))


def per_class(rows: DataFrame, label: str, order: Column, most: int) -> tuple[DataFrame, int]:
    """About ``most`` rows in all, as many of each label, or all of a label that has no more, and the number of labels: rows
    whose hash ``order`` falls under a share that follows from the label's count. Deterministic, and without
    bringing a label's rows together."""
    counts = cut(rows.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n")))
    labels = counts.count()
    each = -(-most // max(1, labels))
    draw = F.pmod(order, F.lit(1 << 30)) * F.col("__n") < F.lit(each) * F.lit(1 << 30).cast("long")
    drawn = rows.join(F.broadcast(counts) if labels <= FEW else counts, rows[label] == counts["__label"]).filter(draw)
    if labels > most:  # a label's share of less than one row
        drawn = drawn.filter(F.pmod(F.xxhash64(label), F.lit(labels)) < most)
    return drawn.drop("__label", "__n"), labels
