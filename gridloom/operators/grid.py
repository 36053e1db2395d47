"""Gridded tables: cells and tiles, slices and borders, ghosts and neighbours.

Cells: run_id, t, v, i, j, value. Tiles: run_id, t, bi, bj, ni, nj, data (values by v, then by rows). ni and nj are a tile's
extents, at most the tile size and less where the grid ends within a tile; nulls in data mark the cells that it lacks (a
cell without a value is lacking).
Every operator keys by the run, so that many runs go through together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("run_id", "t", "v")
TILE_LIMIT = 4 << 20


def rasterize(df: DataFrame, nx: int, ny: int, run: Column, i: Column, j: Column, values: dict[str, Column]) -> DataFrame:
    """Sums of df's columns on a dense nx x ny grid for each run (columns run_id, i, j and values);
    cells without rows are 0."""
    sums = df.select(run.alias("run_id"), F.pmod(i, F.lit(nx)).cast("int").alias("i"), F.pmod(j, F.lit(ny)).cast("int").alias("j"), *(c.alias(n) for n, c in values.items()))
    sums = sums.groupBy("run_id", "i", "j").agg(*(F.sum(n).alias(n) for n in values))
    every = sums.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("i"))
    every = every.select("run_id", "i", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("j"))
    return every.join(sums, ["run_id", "i", "j"], "left").select("run_id", "i", "j", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in values))


def to_cell_layout(df: DataFrame, value: str, t: int = 0, v: int = 0) -> DataFrame:
    return df.select("run_id", F.lit(t).alias("t"), F.lit(v).alias("v"), "i", "j", F.col(value).cast("double").alias("value"))


def check_tiling(nx: int, ny: int, bs: int, variables: int = 1) -> None:
    if min(nx, ny, bs, variables) < 1:
        raise ValueError(f"no tiles of {bs} in a {nx} x {ny} grid")
    if bs * bs * variables > TILE_LIMIT:
        raise ValueError(f"tiles of {bs} x {bs} x {variables} values are too large for one row")


def to_tiles(cells: DataFrame, nx: int, ny: int, bs: int, variables: int = 1) -> DataFrame:
    """G1: one shuffle by tile; a tile's size is bounded by TILE_LIMIT. Every value goes to its place, so that lacking cells
    don't move others. A cell that stands twice, or lies outside of the grid, is an error. Tiles without any cell are lacking themselves."""
    check_tiling(nx, ny, bs, variables)
    inside = f"i BETWEEN 0 AND {nx - 1} AND j BETWEEN 0 AND {ny - 1} AND v BETWEEN 0 AND {variables - 1}"
    wrong = "raise_error(concat_ws(' ', 'no such cell in the grid:', v, i, j))"
    placed = cells.selectExpr("run_id", "t", f"CAST(CASE WHEN {inside} THEN i ELSE {wrong} END div {bs} AS int) AS bi", f"CAST(j div {bs} AS int) AS bj", "v", "i", "j", "CAST(value AS double) AS value")
    extents = (f"CAST(least({bs}, {nx} - bi * {bs}) AS int) AS ni", f"CAST(least({bs}, {ny} - bj * {bs}) AS int) AS nj")
    indexed = placed.selectExpr("*", *extents).selectExpr("run_id", "t", "bi", "bj", "ni", "nj", f"struct((v * ni + i % {bs}) * nj + j % {bs} AS k, value) AS cell")
    tile = indexed.groupBy("run_id", "t", "bi", "bj", "ni", "nj").agg(F.array_sort(F.collect_list("cell")).alias("__s"))
    checked = tile.selectExpr("*", f"{variables} * ni * nj AS __n", "aggregate(__s, -1L, (p, e) -> CASE WHEN p = -2 OR e.k = p THEN -2L ELSE CAST(e.k AS bigint) END) = -2 AS __twice")
    gap = "array_repeat(CAST(NULL AS double), CAST(e.k - CASE WHEN x = 0 THEN -1 ELSE __s[x - 1].k END - 1 AS int))"
    sparse = f"concat(flatten(transform(__s, (e, x) -> concat({gap}, array(e.value)))), array_repeat(CAST(NULL AS double), CAST(__n - 1 - element_at(__s, -1).k AS int)))"
    data = f"CASE WHEN __twice THEN raise_error(concat_ws(' ', 'a cell stands twice in tile', bi, bj)) WHEN size(__s) = __n THEN transform(__s, e -> e.value) ELSE {sparse} END"
    return checked.selectExpr("run_id", "t", "bi", "bj", "ni", "nj", f"{data} AS data")


def to_cells(tiles: DataFrame, bs: int) -> DataFrame:
    """The cells that tiles have; no shuffle."""
    out = tiles.select("run_id", "t", "bi", "bj", "ni", "nj", F.posexplode("data").alias("k", "value")).filter("value IS NOT NULL")
    place = {"v": "k div (ni * nj)", "i": f"bi * {bs} + (k div nj) % ni", "j": f"bj * {bs} + k % nj"}
    return out.select("run_id", "t", *(F.expr(e).cast("int").alias(n) for n, e in place.items()), "value")


def slice_cells(cells: DataFrame, **ranges) -> DataFrame:
    """P5: keeps rows whose key columns are a value, or in a (first, last) range."""
    for name, want in ranges.items():
        cells = cells.filter(F.col(name).between(*want) if isinstance(want, tuple) else F.col(name) == want)
    return cells


def interior(cells: DataFrame, nx: int, ny: int, r: int) -> DataFrame:
    """P6."""
    return cells.filter(F.col("i").between(r, nx - 1 - r) & F.col("j").between(r, ny - 1 - r))


def border(cells: DataFrame, nx: int, ny: int, r: int, side: str | None = None) -> DataFrame:
    """The strip of width r on one side (west, east, south, north), or on all."""
    i, j = F.col("i"), F.col("j")
    sides = {"west": i < r, "east": i >= nx - r, "south": j < r, "north": j >= ny - r}
    return cells.filter(sides[side] if side else sides["west"] | sides["east"] | sides["south"] | sides["north"])


def with_ghosts(cells: DataFrame, nx: int, ny: int, r: int) -> DataFrame:
    """U4: cells and their periodic copies up to r outside the grid; only copies near it are made."""
    near = lambda x, n: F.array_compact(F.array(x, F.when(x < r, x + n), F.when(x >= n - r, x - n)))
    return cells.withColumn("i", F.explode(near(F.col("i"), nx))).withColumn("j", F.explode(near(F.col("j"), ny)))


def mirror_concat(cells: DataFrame, nx: int) -> DataFrame:
    """The field mirrored along i, then the field."""
    return cells.withColumn("i", F.explode(F.array(nx - 1 - F.col("i"), nx + F.col("i"))))


def repeat_line(line: DataFrame, n: int, axis: str = "j") -> DataFrame:
    """The line at each of n places of the other axis."""
    return line.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def with_neighbors(cells: DataFrame, offsets: list[tuple[int, int]], nx: int, ny: int, value: Column | str = "value", keys=KEYS, carry=()) -> DataFrame:
    """Keys, i, j and n0, n1, ...: the periodic neighbour's value at each offset. Cells are
    scattered to those that need them and met in one shuffle, without self-joins. ``carry``
    columns are taken from the cell itself, which needs the offset (0, 0)."""
    value = F.col(value) if isinstance(value, str) else value
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(offsets)))
    sent = cells.select(*keys, "i", "j", value.alias("__value"), *carry, F.explode(steps).alias("__o"))
    to = lambda name, part, n: F.pmod(F.col(name) - F.col(f"__o.{part}"), F.lit(n)).cast("int").alias(name)
    sent = sent.select(*keys, to("i", "a", nx), to("j", "b", ny), F.col("__o.k").alias("__k"), "__value", *carry)
    own = [F.max(F.when(F.col("__k") == offsets.index((0, 0)), F.col(c))).alias(c) for c in carry]
    return sent.groupBy(*keys, "i", "j").agg(*(F.max(F.when(F.col("__k") == k, F.col("__value"))).alias(f"n{k}") for k in range(len(offsets))), *own)
