"""Least-squares effects of many levels of several attributes, by conjugate gradients on tables.

The model is vec = sum over attributes of the effect of the row's level.  Data
enter through one aggregate for each combination of levels (a cell).  The normal
equations are never written down: a step sends the direction of each level to
its cells, and the cells' products back to the levels.  All dimensions go
through the same steps, each with lengths of its own.  Effects stay rows of a table;
the driver sees a few numbers per dimension and step.  They are free by a constant
that one attribute gives to another; their sum, the fit, is not.

Rows with a null attribute or a null vector have no cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.operators._util import stored

#: Bytes of effects of one attribute that are broadcast to its cells, by count; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Length of the residual of the normal equations, against that at the start, at which a dimension is done.
TOLERANCE = 1e-12
MAX_STEPS = 1000


def _sums(column: str, d: int):
    """Sum of arrays, place by place: as many partial sums as places, no arrays gathered."""
    return F.array(*[F.sum(F.col(column)[j]) for j in range(d)])


def _plus(a, b, factors=None):
    """a + factors * b of arrays, place by place."""
    if factors is None:
        return F.zip_with(a, b, lambda x, y: x + y)
    scaled = F.zip_with(b, F.array(*[F.lit(float(f)) for f in factors]), lambda y, f: y * f)
    return F.zip_with(a, scaled, lambda x, y: x + y)


def _times(a, b):
    return F.zip_with(a, b, lambda x, y: x * y)


def _few(levels: DataFrame, n_attrs: int, d: int) -> list[bool]:
    """For each attribute, whether the effects of its levels, which are counted, may be broadcast."""
    counts = {r["_a"]: r["n"] for r in levels.groupBy("_a").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each attribute
    return [8 * max(1, d) * counts.get(i, 0) <= BROADCAST_BYTES for i in range(n_attrs)]


def _with_levels(cells: DataFrame, levels: DataFrame, column: str, few: Sequence[bool]) -> DataFrame:
    """``cells`` with ``_fit``: the sum of ``column`` over the levels of a cell."""
    fit = None
    for i, small in enumerate(few):
        own = levels.where(F.col("_a") == i).select(F.col("_l").alias(f"_l{i}"), F.col(column).alias(f"_v{i}"))
        own = F.broadcast(own) if small else own
        cells = cells.join(own, f"_l{i}", "inner")
        fit = F.col(f"_v{i}") if fit is None else _plus(fit, F.col(f"_v{i}"))
    return cells.withColumn("_fit", fit).drop(*[f"_v{i}" for i in range(len(few))])


def _by_level(cells: DataFrame, column: str, n_attrs: int, d: int, out: str) -> DataFrame:
    """(_a, _l, out): the sum of ``column`` over the cells of each level."""
    places = F.array(*[F.struct(F.lit(i).alias("_a"), F.col(f"_l{i}").alias("_l")) for i in range(n_attrs)])
    long = cells.select(F.explode(places).alias("_at"), F.col(column).alias("_w"))
    return long.groupBy("_at._a", "_at._l").agg(_sums("_w", d).alias(out))


def level_effects(df: DataFrame, attrs: Sequence[str], vec: str, tolerance: float = TOLERANCE,
                  max_steps: int = MAX_STEPS) -> DataFrame:
    """(_a, _l, effect): number of the attribute, its level as text, and the level's effect (array<double>)."""
    k = len(attrs)
    if not k:
        raise ValueError("no attribute")
    rows = df.select(*[F.col(a).cast("string").alias(f"_l{i}") for i, a in enumerate(attrs)], F.col(vec).cast("array<double>").alias("_v"))
    rows = rows.where(" AND ".join([f"_l{i} IS NOT NULL" for i in range(k)] + ["_v IS NOT NULL"]))
    first = rows.select(F.size("_v").alias("d")).first()
    d = first["d"] if first else 0
    keys = [f"_l{i}" for i in range(k)]
    cells = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_n"), _sums("_v", d).alias("_s")), "cells")
    sizes = cells.withColumn("_n1", F.array(F.col("_n")))
    # x: effects, r: residual, p: direction, _m: rows of the level, which precondition
    state = _by_level(cells, "_s", k, d, "r").join(_by_level(sizes, "_n1", k, 1, "_m"), ["_a", "_l"])
    scaled = F.transform("r", lambda v: v / F.col("_m"))
    state = stored(state.withColumn("_m", F.col("_m")[0]).withColumn("x", F.array_repeat(F.lit(0.0), d)).withColumn("p", scaled), "levels")

    def lengths(table: DataFrame, product) -> list[float]:
        sums = table.select(product.alias("_w")).agg(_sums("_w", d).alias("_w")).first()["_w"]
        return [v or 0.0 for v in sums]

    norm = F.transform("r", lambda v: v * v / F.col("_m"))
    rho = lengths(state, norm)
    few = _few(state, k, d)
    done = [tolerance * tolerance * v for v in rho]
    for _ in range(max_steps):
        if all(v <= stop for v, stop in zip(rho, done)):
            return state.select("_a", "_l", F.col("x").alias("effect"))
        products = _with_levels(cells, state.select("_a", "_l", "p"), "p", few)
        products = products.withColumn("_w", F.transform("_fit", lambda v: v * F.col("_n")))
        ahead = stored(state.join(_by_level(products, "_w", k, d, "q"), ["_a", "_l"]), "levels")
        curve = lengths(ahead, _times("p", "q"))
        step = [r / c if r > stop and c > 0 else 0.0 for r, c, stop in zip(rho, curve, done)]
        state = ahead.select("_a", "_l", "_m", _plus("x", "p", step).alias("x"), _plus("r", "q", [-v for v in step]).alias("r"), "p")
        now = lengths(state, norm)
        turn = [n / r if r > stop else 0.0 for n, r, stop in zip(now, rho, done)]
        rho = [n if s else 0.0 for n, s in zip(now, step)]
        state = state.withColumn("p", _plus(scaled, "p", turn))
    raise RuntimeError(f"no fit after {max_steps} steps")


def residualize_levels(df: DataFrame, attrs: Sequence[str], emb: str = "embedding", **options) -> DataFrame:
    """Adds ``residual``: ``emb`` minus the sum of its levels' effects; rows with a null attribute or vector go."""
    names = list(attrs)
    effects = stored(level_effects(df, names, emb, **options), "effects")
    first = effects.select(F.size("effect").alias("d")).first()
    d = first["d"] if first else 0
    keyed = df.where(F.col(emb).isNotNull())
    for i, a in enumerate(names):
        keyed = keyed.withColumn(f"_l{i}", F.col(a).cast("string"))
    out = _with_levels(keyed, effects, "effect", _few(effects, len(names), d))
    residual = F.zip_with(F.col(emb).cast("array<double>"), F.col("_fit"), lambda v, f: v - f)
    return out.select(*df.columns, residual.alias("residual"))
