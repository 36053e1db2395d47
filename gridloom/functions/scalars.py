"""Scalar functions on columns: coordinates, shares, sizes, frames, texts, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for true and for false, in any case.
TRUE_TEXTS, FALSE_TEXTS = ("yes", "true", "t", "y", "1"), ("no", "false", "f", "n", "0")
STAMP = "MM/dd/yyyy-HH:mm:ss"


def coordinate(k: Column, a: float, b: float, n: int, endpoint: bool = False) -> Column:
    """M1: the k-th of n even places from a to b; a itself if there is one place only."""
    steps = n - 1 if endpoint else n
    return F.coalesce(F.lit(float(a)) + F.try_divide(F.lit(float(b - a)) * k, F.lit(float(steps))), F.lit(float(a)))


def pad_size(size: Column, block: Column) -> Column:
    """Size rounded up to a multiple of block."""
    return size + F.pmod(-size, block)


def effective_share(share: Column, size: Column, block: Column) -> Column:
    """The share of whole rows of blocks; five digits are kept before rounding up."""
    rows = F.ceil(size / block)
    return F.ceil(F.round(share * rows, 5)) / rows


def heat_step(n: Column, alpha: Column, endpoint: bool = False) -> Column:
    """Step in time for n places on a unit axis and a diffusivity."""
    dx = F.lit(1.0) / (n - 1 if endpoint else n)
    return F.lit(0.1) * dx * dx / alpha


def euler_step_size(n: Column, endpoint: bool = False) -> Column:
    """Step in time for n places on an axis of length 10."""
    return F.lit(0.1) * (F.lit(10.0) / (n - 1 if endpoint else n))


def standard_frames(t0: Column, tf: Column, dt: Column) -> Column:
    """Frames of a run with one exchange per step; truncates."""
    return ((tf - t0) / dt).cast("int") + 1


def multi_step_frames(steps: Column, block: Column, ops: Column, stages: Column) -> Column:
    """Frames of a run with several steps per exchange; truncates."""
    half = F.floor(block / (F.lit(2) * ops)) - 1
    rounds = (stages * steps / half - 1).cast("int")
    return (half * (rounds + 1) / stages + 1).cast("int")


def text_to_boolean(text: Column, strict: bool = False) -> Column:
    """Yes / true / t / y / 1 and no / false / f / n / 0 in any case; else null, or an error."""
    low = F.lower(text)
    other = F.raise_error(F.concat(F.lit("no boolean: "), text)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False).otherwise(other)


def parse_stamp(text: Column) -> Column:
    """Month first, day, year, time."""
    return F.try_to_timestamp(text, F.lit(STAMP))


def format_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def rounded_share(share: Column) -> Column:
    """To one digit, halves to the even one."""
    return F.bround(share * 10, 0) / 10


def run_summary(swept: Column, block: Column, share: Column, seconds: Column) -> Column:
    """One line about a run."""
    return F.concat_ws(", ", F.when(swept, "several steps").otherwise("one step"), F.format_string("block %d", block.cast("long")), F.format_string("share %.2f", share), F.format_string("%.3f s", seconds))


def wrapped(array: Column, index: Column) -> Column:
    """Element at a zero-based index that wraps around."""
    return F.element_at(array, (F.pmod(index, F.size(array)) + 1).cast("int"))


def mirrored(array: Column) -> Column:
    """The reversed array before the array."""
    return F.concat(F.reverse(array), array)


def repeated(array: Column, n: int) -> Column:
    """N copies one after the other."""
    return F.flatten(F.array_repeat(array, n))


def lookup(map_column: Column, key, default) -> Column:
    """A map's value or a default."""
    return F.coalesce(F.try_element_at(map_column, F.lit(key)), F.lit(default))
