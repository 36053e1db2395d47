"""Neighbour updates on cells: linear stencils, two-stage steps, borders, lines, Euler fluxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.session import cut_lineage
from .grid import with_neighbors

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


class StencilSpec:
    """a linear stencil as data: (di, dj, weight) and the weight of the cell itself."""

    def __init__(self, arms, centre: float = 0.0):
        self.arms, self.centre = tuple(arms), centre

    @property
    def offsets(self) -> list[tuple[int, int]]:
        return [(0, 0), *((a, b) for a, b, _ in self.arms)]

    def apply(self) -> Column:
        """Over columns n0, n1, ... in a fixed order, so that results repeat to the last bit."""
        terms = [F.col(f"n{k}") * w for k, (_, _, w) in enumerate(self.arms, 1)]
        total = reduce(lambda a, b: a + b, terms)
        return F.col("n0") * self.centre + total if self.centre else total


    @property
    def table(self) -> dict[tuple[int, int], float]:
        """Offsets and weights, the centre among them; equal offsets added up."""
        found = {(0, 0): self.centre} if self.centre else {}
        for a, b, w in self.arms:
            found[a, b] = found.get((a, b), 0.0) + w
        return found

    def after(self, first: StencilSpec) -> StencilSpec:
        """One stencil for two steps, ``first`` and then this one: the convolution of their tables. Weights that cancel stay, as the
        cells that they stand for are needed by the steps."""
        found: dict[tuple[int, int], float] = {}
        for (a, b), w in self.table.items():
            for (c, d), x in first.table.items():
                found[a + c, b + d] = found.get((a + c, b + d), 0.0) + w * x
        return StencilSpec([(a, b, w) for (a, b), w in sorted(found.items()) if (a, b) != (0, 0)], found.get((0, 0), 0.0))

    def power(self, steps: int) -> StencilSpec:
        """One stencil for so many steps of this one, by repeated squaring."""
        if steps < 1:
            raise ValueError("at least one step")
        half = self.power(steps // 2) if steps > 1 else None
        return self if half is None else half.after(half) if steps % 2 == 0 else self.after(half.after(half))


def mean4() -> StencilSpec:
    return StencilSpec([(a, b, 0.25) for a, b in FOUR])


def diffuse(c: float, cy: float | None = None) -> StencilSpec:
    cy = c if cy is None else cy
    return StencilSpec([(-1, 0, c), (1, 0, c), (0, -1, cy), (0, 1, cy)], 1 - 2 * c - 2 * cy)


def diffuse_rate(c: float) -> StencilSpec:
    """The change alone: what diffuse adds to the cell."""
    return StencilSpec([(a, b, c) for a, b in FOUR], -4 * c)


def stencil_linear(cells: DataFrame, spec: StencilSpec, nx: int, ny: int) -> DataFrame:
    """One step; t grows by one."""
    near = with_neighbors(cells, spec.offsets, nx, ny)
    return near.select("run_id", (F.col("t") + 1).alias("t"), "v", "i", "j", spec.apply().alias("value"))


def stencil_steps(cells: DataFrame, spec: StencilSpec, nx: int, ny: int, steps: int) -> DataFrame:
    """G5 of a linear stencil in one shuffle: its ``steps``-fold convolution, one scatter and one sum; t grows by ``steps``. Each cell is sent to
    about 2 * (radius * steps) ** 2 others, partly summed before the shuffle: for few steps. As with single steps, a cell that needs
    a lacking one has no value. Sums have no fixed order, so that results are equal to the last bit only if they are exact (dyadic weights)."""
    weights = spec.power(steps).table
    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for (a, b), w in weights.items()))
    sent = cells.select("run_id", "t", "v", "i", "j", "value", F.explode(listed).alias("o"))
    to = lambda name, part, n: F.pmod(F.col(name) - F.col(f"o.{part}"), F.lit(n)).cast("int").alias(name)
    sent = sent.select("run_id", (F.col("t") + steps).alias("t"), "v", to("i", "a", nx), to("j", "b", ny), (F.col("value") * F.col("o.w")).alias("part"))
    whole = F.count("part") == len(weights)
    return sent.groupBy("run_id", "t", "v", "i", "j").agg(F.when(whole, F.sum("part")).alias("value"))


def two_stage_step(cells: DataFrame, rate: StencilSpec, nx: int, ny: int) -> DataFrame:
    """half = u + rate(u) / 2, new = u + rate(half); u is carried, not joined."""
    near = with_neighbors(cells, rate.offsets, nx, ny)
    half = near.select("run_id", "t", "v", "i", "j", (F.col("n0") + 0.5 * rate.apply()).alias("value"), F.col("n0").alias("u"))
    full = with_neighbors(half, rate.offsets, nx, ny, carry=("u",))
    return full.select("run_id", (F.col("t") + 1).alias("t"), "v", "i", "j", (F.col("u") + rate.apply()).alias("value"))


def iterate(cells: DataFrame, n: int, step, cut_every: int = 8, save_every: int | None = None) -> DataFrame:
    """N steps, one shuffle each; every save_every-th frame is returned, or the last.
    Lineage is cut every cut_every steps."""
    frames = [cells] if save_every else []
    for k in range(1, n + 1):
        cells = step(cells)
        if k % cut_every == 0 and k < n:
            cells = cut_lineage(cells)
        if save_every and k % save_every == 0:
            frames.append(cells)
    return reduce(DataFrame.unionByName, frames) if save_every else cells


def apply_border(cells: DataFrame, nx: int, ny: int, r: int, west: float, east: float, copy_y: bool = True) -> DataFrame:
    """Constant values on the west and east strips; the south and north strips copy the rows
    that lie as deep on the other side of the interior (periodic), or stay."""
    i, j = F.col("i"), F.col("j")
    fixed = cells.withColumn("value", F.when(i < r, west).when(i >= nx - r, east).otherwise(F.col("value")))
    if not copy_y:
        return fixed
    rows = F.array_compact(F.array(F.when(j.between(r, ny - 1 - r), j), F.when(j.between(ny - 2 * r, ny - r - 1), j - (ny - 2 * r)), F.when(j.between(r, 2 * r - 1), j + (ny - 2 * r))))
    return fixed.withColumn("j", F.explode(rows))


def line_stencil(df: DataFrame, weights: list[float], keys: list[str], order: str, value: str = "value", wrap: bool = False) -> DataFrame:
    """Weighted sum over places -r .. r along each line; where a place is missing, at the ends, the value stays, or the
    line wraps. A null value makes the sums that it takes part in null."""
    r = len(weights) // 2
    w, line = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    placed = df.withColumn("__p", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(line))
    near = [F.col(value) if d == 0 else F.lag(value, -d).over(w) if d < 0 else F.lead(value, d).over(w) for d in range(-r, r + 1)]
    if not wrap:
        total = reduce(lambda a, b: a + b, [n * c for n, c in zip(near, weights)])
        inside = (F.col("__p") >= r) & (F.col("__p") + r < F.col("__n"))
        return placed.withColumn("result", F.when(inside, total).otherwise(F.col(value))).drop("__p", "__n")
    ends = lambda o: F.array(*(F.nth_value(value, k).over(line.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k in range(1, r + 1)))
    # a line of up to 2 r + 1 places lies wholly within 2 r places of each of them
    short = F.collect_list(F.struct(F.col(value).alias("x"))).over(w.rowsBetween(-2 * r, 2 * r))
    out = placed.withColumn("__head", ends(F.col(order).asc())).withColumn("__tail", ends(F.col(order).desc())).withColumn("__short", short)
    p, n, terms = F.col("__p"), F.col("__n"), []
    for d, x in zip(range(-r, r + 1), near):
        at = p + d
        far = F.when(at < 0, F.try_element_at("__tail", (-at).cast("int"))).when(at >= n, F.try_element_at("__head", (at - n + 1).cast("int"))).otherwise(x)
        terms.append(F.when(n <= 2 * r, F.try_element_at("__short", (F.pmod(at, n) + 1).cast("int"))["x"]).otherwise(far))
    total = reduce(lambda a, b: a + b, [x * c for x, c in zip(terms, weights)])
    return out.withColumn("result", total).drop("__p", "__n", "__head", "__tail", "__short")


def _faces(q, p, limit):
    """Left and right states at the two faces of the middle one of five cells."""
    at = lambda a, b, num, den: [x + limit(num, den) * (y - x) for x, y in zip(q[a], q[b])]
    west = at(1, 2, p[2] - p[1], p[1] - p[0]), at(2, 1, p[2] - p[1], p[3] - p[2])
    east = at(2, 3, p[3] - p[2], p[2] - p[1]), at(3, 2, p[3] - p[2], p[4] - p[3])
    return west, east


def _layered(df: DataFrame, prefix: str, columns: list[Column]) -> tuple[DataFrame, list[Column]]:
    """Names intermediate results, so that expressions don't multiply."""
    return df.withColumns({f"{prefix}{k}": c for k, c in enumerate(columns)}), [F.col(f"{prefix}{k}") for k in range(len(columns))]


def _divergence(df: DataFrame, q, name: str, axis: int, limit) -> tuple[DataFrame, list[Column]]:
    df, p = _layered(df, f"__{name}p", [fields.pressure(c) for c in q])
    total = [F.lit(0.0)] * len(q[0])
    for side, sign, (left, right) in zip("we", (1, -1), _faces(q, p, limit)):
        df, left = _layered(df, f"__{name}{side}l", left)
        df, right = _layered(df, f"__{name}{side}r", right)
        parts = [*fields.flux(left, right, axis), *fields.spectral(left, right, axis)]
        df, parts = _layered(df, f"__{name}{side}f", parts)
        n = len(left)
        total = [t + sign * a for t, a in zip(total, parts[:n])]
        total = [t + sign * a for t, a in zip(total, parts[n:])]
    return df, [0.5 * t for t in total]


def flux_residual(cells: DataFrame, nx: int, ny: int, keys=("run_id", "t")) -> DataFrame:
    """Cells (keys, i, j, q0 .. q3) to keys, i, j, x0 .. x3, y0 .. y3: the flux divergence
    along both axes; one shuffle for the nine cells that are needed."""
    offsets = [(0, 0), (-2, 0), (-1, 0), (1, 0), (2, 0), (0, -2), (0, -1), (0, 1), (0, 2)]
    near = with_neighbors(cells, offsets, nx, ny, F.struct("q0", "q1", "q2", "q3"), keys)
    q = [[F.col(f"n{k}.q{c}") for c in range(4)] for k in range(9)]
    near, x = _divergence(near, [q[1], q[2], q[0], q[3], q[4]], "x", 1, fields.limit_ratio)
    near, y = _divergence(near, [q[5], q[6], q[0], q[7], q[8]], "y", 2, fields.limit_ratio)
    return near.select(*keys, "i", "j", *(F.col(f"n0.q{k}").alias(f"q{k}") for k in range(4)), *(c.alias(f"x{k}") for k, c in enumerate(x)), *(c.alias(f"y{k}") for k, c in enumerate(y)))


def line_flux_step(df: DataFrame, dt: float, keys: list[str], order: str = "i") -> DataFrame:
    """Half a step in time of a gas line (keys, i, q0, q1, q2: density, momentum, energy); the
    two cells at each end stay. The line's places are 1 / (n - 5) apart."""
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    shifted = {f"__s{d}_{k}": F.lag(f"q{k}", 2 - d).over(w) if d < 2 else F.lead(f"q{k}", d - 2).over(w) for d in (0, 1, 3, 4) for k in range(3)}
    out = df.withColumns(shifted).withColumn("__dx", 1 / (F.count("*").over(whole) - 5).cast("double"))
    q = [[F.col(f"q{k}") if d == 2 else F.col(f"__s{d}_{k}") for k in range(3)] for d in range(5)]
    out, change = _divergence(out, q, "l", 1, fields.limit_ratio_signed)
    return out.select(*keys, order, *(F.coalesce(F.col(f"q{k}") + dt / F.col("__dx") * 0.5 * c, F.col(f"q{k}")).alias(f"q{k}") for k, c in enumerate(change)))
