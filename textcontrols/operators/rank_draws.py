"""Rank-normalised convergence measures of a draws table, distributed.

Split R-hat (the larger of bulk and folded tail) and bulk effective sample
size after Vehtari et al. 2021, for groups of any size: draws are ranked in
range slices, ties at their average; autocovariances are sums of products of
blocks of chains, by ranges of lags, until Geyer's sequence has ended.  No
task holds a chain or a group.

Defined results: null and NaN draws are left out; chains may differ in length;
the middle draw of an odd chain is in no half; a half of one draw is left out;
a group without a half, or without any spread, has null measures.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcontrols.functions.stats import normal_quantile
from textcontrols.operators._util import average_ranks, stored
from textcontrols.operators.draws import draw_quantiles, placed_draws

#: Draws of a block, the first range of lags, and the growth of the ranges.
BLOCK, FIRST_LAGS, GROWTH = 4096, 64, 4


def _scores(placed: DataFrame, value: str, out: str) -> DataFrame:
    """Normal scores of the ranks within ``_g``, in the column ``out``."""
    ranked = average_ranks(placed.withColumn("_tie", F.struct("_chain", "_at")), "_g", value, "_tie", "_rank").drop("_tie")
    size = ranked.groupBy("_g").agg(F.count(F.lit(1)).alias("_size"))
    p = (F.col("_rank") - 0.375) / (F.col("_size") + 0.25)
    return ranked.join(size, "_g").withColumn(out, normal_quantile(p)).drop("_rank", "_size")


def _placed(draws: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """_g, _chain, _at, _len, _v of every draw with a value."""
    there = draws.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = there.select(F.struct(*keys).alias("_g"), "chain", "draw", F.col(value).cast("double").alias("_v"))
    return placed_draws(rows, ["_g"], "_v").select("_g", F.col("chain").alias("_chain"), "_at", "_len", "_v")


def _halves(scored: DataFrame) -> DataFrame:
    """Adds ``_half`` and ``_place``, the place in it, and ``_held``, its length."""
    held = F.floor(F.col("_len") / 2)
    half = F.when(F.col("_at") < held, 0).when(F.col("_at") >= F.col("_len") - held, 1)
    return (scored.withColumn("_half", half).where(F.col("_half").isNotNull() & (held > 1))
            .withColumn("_place", F.when(F.col("_half") == 0, F.col("_at")).otherwise(F.col("_at") - (F.col("_len") - held)))
            .withColumn("_held", held))


def _spread(halves: DataFrame, score: str) -> DataFrame:
    """_g, n (mean length), w (mean variance within), b (variance of the means), total, longest."""
    one = halves.groupBy("_g", "_chain", "_half").agg(F.count(F.lit(1)).alias("m"), F.avg(score).alias("mu"), F.var_samp(score).alias("s2"))
    return one.groupBy("_g").agg(F.avg("m").alias("n"), F.avg("s2").alias("w"), F.coalesce(F.var_samp("mu"), F.lit(0.0)).alias("b"),
                                 F.sum("m").alias("total"), F.max("m").alias("longest"))


def _rhat(spread: DataFrame, out: str) -> DataFrame:
    n, w, b = F.col("n"), F.col("w"), F.col("b")
    return spread.select("_g", F.when(w > 0, F.sqrt(((n - 1) / n * w + b) / w)).alias(out))


def _counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("_g").agg(F.count_distinct("_chain").alias("n_chains"), F.count(F.lit(1)).alias("n_draws"))


def rank_rhat(draws: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """keys, n_chains, n_draws, rhat: the larger of the R-hats of the scores and of the scores of the folded draws."""
    placed = stored(_placed(draws, keys, value), "draws")
    middle = draw_quantiles(placed, ["_g"], "_v", (0.5,)).select("_g", F.col("q500").alias("_mid"))
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("tail"), F.col("_v").alias("v")),
                              F.struct(F.lit(True).alias("tail"), F.abs(F.col("_v") - F.col("_mid")).alias("v")))).alias("_k")
    both = placed.join(middle, "_g").select("_g", "_chain", "_at", "_len", kinds)
    both = both.select(F.struct("_g", "_k.tail").alias("_g"), "_chain", "_at", "_len", F.col("_k.v").alias("_v"))
    each = _rhat(_spread(_halves(_scores(both, "_v", "_z")), "_z"), "rhat")
    larger = each.groupBy(F.col("_g._g").alias("_g")).agg(F.max("rhat").alias("rhat"))
    return _counts(placed).join(larger, "_g", "left").select("_g.*", "n_chains", "n_draws", "rhat")


# ---------------------------------------------------------------- effective sample size
def _products(low: int, high: int, size: int):
    """Sums of products at the lags ``low`` to ``high`` (exclusive) of pairs of blocks, ``gap`` blocks apart."""
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1)
                gap, left, right = r.column("gap")[0].as_py(), *(r.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("left", "right"))
                first = max(low, gap * size - len(left) + 1)
                last = min(high, gap * size + len(right))
                if first >= last:
                    continue
                turn = 1 << (len(left) + len(right) - 1).bit_length()
                # at k: the sum over i of left[i] * right[i + k], for k from -(len(left) - 1) on
                every = np.fft.irfft(np.conj(np.fft.rfft(left, turn)) * np.fft.rfft(right, turn), turn)
                lags = np.arange(first, last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.column("row")[0].as_py()] * len(lags), pa.int64()), pa.array(lags, pa.int64()), pa.array(every[(lags - gap * size) % turn])],
                    names=["row", "lag", "s"])

    return run


def lagged_products(blocks: DataFrame, low: int, high: int, size: int = BLOCK) -> DataFrame:
    """(row, lag, s) of blocks (row, block, x): s sums x[i] * x[i + lag] over a whole sequence ``row``."""
    gaps = [g for g in range(0, high // size + 2) if (g - 1) * size < high and (g + 1) * size > low]
    right = blocks.select("row", F.explode(F.array(*[F.lit(g) for g in gaps])).alias("gap"), "block", F.col("x").alias("right"))
    right = right.select("row", "gap", (F.col("block") - F.col("gap")).alias("block"), "right").where("block >= 0")
    pairs = blocks.select("row", "block", F.col("x").alias("left")).join(right, ["row", "block"])
    found = pairs.select("row", "gap", "left", "right").mapInArrow(_products(low, high, size), "row long, lag long, s double")
    return found.groupBy("row", "lag").agg(F.sum("s").alias("s"))


def rank_ess(draws: DataFrame, keys: Sequence[str], value: str = "value", size: int = BLOCK, first_lags: int = FIRST_LAGS) -> DataFrame:
    """keys, n_chains, n_draws, ess_bulk: draws over the sum of autocorrelations of the scores, cut as Geyer does.

    The measure may exceed the draws S, up to S * log10(S), as for anticorrelated draws.
    """
    placed = stored(_placed(draws, keys, value), "draws")
    halves = stored(_halves(_scores(placed, "_v", "_z")), "halves")
    n, w = F.col("n"), F.col("w")
    spread = stored(_spread(halves, "_z").withColumn("_plus", w * (n - 1) / n + F.col("b")), "spread")
    one = halves.groupBy("_g", "_chain", "_half").agg(F.avg("_z").alias("_mean"), F.max("_held").alias("_held"))
    one = stored(one.withColumn("row", F.monotonically_increasing_id()), "rows")
    centred = halves.join(one.select("_g", "_chain", "_half", "row", "_mean"), ["_g", "_chain", "_half"])
    block = F.floor(F.col("_place") / size).cast("int").alias("block")
    cells = F.sort_array(F.collect_list(F.struct("_place", (F.col("_z") - F.col("_mean")).alias("x"))))  # at most ``size`` of them
    blocks = stored(centred.groupBy("row", block).agg(cells.alias("cells")).select("row", "block", F.col("cells.x").alias("x")), "blocks")

    low, high, open_groups, parts = 0, first_lags, spread.where(F.col("_plus") > 0).select("_g"), None
    while True:
        rows = one.join(open_groups, "_g").select("_g", "row", "_held")
        sums = lagged_products(blocks.join(rows.select("row"), "row"), low, high, size)
        # every half that is longer than the lag counts
        mean = sums.join(rows, "row").where(F.col("lag") < F.col("_held")).groupBy("_g", "lag").agg(F.avg(F.col("s") / F.col("_held")).alias("acov"))
        rho = mean.join(spread.select("_g", "w", "_plus", "longest"), "_g").select(
            "_g", "longest", "lag", F.when(F.col("lag") == 0, 1.0).otherwise(1 - (w - F.col("acov")) / F.col("_plus")).alias("rho"))
        pairs = rho.groupBy("_g", F.floor(F.col("lag") / 2).alias("k")).agg(F.sum("rho").alias("pair"), F.count(F.lit(1)).alias("both"))
        pairs = stored(pairs.where("both = 2").select("_g", "k", "pair"), "pairs")
        parts = pairs if parts is None else parts.unionByName(pairs)
        ended = pairs.where("pair <= 0").select("_g").distinct()
        open_groups = stored(open_groups.join(ended, "_g", "left_anti").join(spread.select("_g", "longest"), "_g")
                             .where(F.col("longest") > high).select("_g"), "open")
        if open_groups.isEmpty():
            break
        low, high = high, high * GROWTH
    cut = parts.where("pair <= 0").groupBy("_g").agg(F.min("k").alias("cut"))
    falling = Window.partitionBy("_g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row for each pair before the cut
    kept = parts.join(cut, "_g", "left").where(F.col("cut").isNull() | (F.col("k") < F.col("cut")))
    summed = kept.withColumn("least", F.min("pair").over(falling)).groupBy("_g").agg(F.sum("least").alias("pairs"))
    total = F.col("total")
    tau = F.greatest(2 * F.coalesce("pairs", F.lit(0.0)) - 1, 1 / F.log10(F.greatest(total, F.lit(11))))
    ess = spread.join(summed, "_g", "left").select("_g", F.when(F.col("_plus") > 0, total / tau).alias("ess_bulk"))
    return _counts(placed).join(ess, "_g", "left").select("_g.*", "n_chains", "n_draws", "ess_bulk")
