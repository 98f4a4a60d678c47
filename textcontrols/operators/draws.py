"""Posterior draws tables: quantiles, paired differences, convergence diagnostics.

A draws table is long: (keys..., chain, draw, value).  Everything here is an
aggregate over it; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcontrols.operators._util import DEFAULT_BROADCAST_ROWS, dense_rank_by, slices, stored

# The reported interval probabilities.
PROBS = (0.025, 0.5, 0.975)


def draw_quantiles(draws: DataFrame, keys: Sequence[str], value: str, probs=PROBS) -> DataFrame:
    """Exact quantiles (linear interpolation, R type 7) and the mean per group.

    The values are cut into ranges, equal ones apart by their row, so a value
    that most rows share is spread as well.  Counts of the slices say which of
    them hold the two order statistics next to each quantile; only those are
    sorted and numbered.
    """
    x = (draws.select(F.struct(*keys).alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
         .withColumn("_row", F.monotonically_increasing_id()))
    cut = slices(x, ["_g", "_v", "_row"]).drop("_row")
    held = cut.groupBy("_g", "_pid").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy("_g")  # a row for each slice
    before = own.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    held = stored(held.select("_g", "_pid", "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(own).alias("n")), "held")
    size = cut.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    names = [f"q{str(p).replace('0.', '').ljust(3, '0')}" for p in probs]
    place = {p: (F.col("n") - 1) * F.lit(p) for p in probs}
    inside = lambda at: (F.col("_off") <= at) & (at < F.col("_off") + F.col("_c"))
    asked = F.lit(False)
    for h in place.values():
        asked = asked | inside(F.floor(h)) | inside(F.floor(h) + 1)
    some = held.where(asked).select("_g", "_pid", "_off", "n")  # at most two slices for each quantile of a group
    rows = cut.join(F.broadcast(some) if _few(some) else some, ["_g", "_pid"])
    rows = rows.withColumn("_at", F.col("_off") + F.row_number().over(Window.partitionBy("_pid", "_g").orderBy("_v")) - 1)
    aggs, near = [], F.lit(False)
    for h, nm in zip(place.values(), names):
        low = F.floor(h)
        near = near | (F.col("_at") == low) | (F.col("_at") == low + 1)
        share = F.when(F.col("_at") == low, 1 - (h - low)).when(F.col("_at") == low + 1, h - low)
        aggs.append(F.sum(F.col("_v") * share).alias(nm))
    got = rows.where(near).groupBy("_g").agg(*aggs)
    return size.join(got, "_g").select("_g.*", "n", "mean", *names)


def _few(groups: DataFrame) -> bool:
    """One row per group: broadcast only below the counted bound."""
    return groups.limit(DEFAULT_BROADCAST_ROWS + 1).count() <= DEFAULT_BROADCAST_ROWS


def posterior_diff_closed(est: DataFrame, keys: Sequence[str], label_col: str, labels: Sequence[str],
                          ref: str, digits: int = 4) -> DataFrame:
    """Difference of two independent posteriors: mean difference, se = sqrt(se_a^2 + se_b^2)."""
    a = est.where(F.col(label_col).isin(list(labels))).alias("a")
    b = est.where(F.col(label_col) == ref).alias("b")
    j = a.join(b, list(keys), "inner")
    return j.select(*keys, F.concat(F.col(f"a.{label_col}"), F.lit("-" + ref)).alias("comparison"),
                    F.round(F.col("a.estimate") - F.col("b.estimate"), digits).alias("delta"),
                    F.round(F.sqrt(F.col("a.est_error") ** 2 + F.col("b.est_error") ** 2), digits).alias("se"))


def paired_draw_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Draw-by-draw difference of two draws tables joined on (keys, chain, draw)."""
    on = [*keys, "chain", "draw"]
    return (a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on, "inner")
            .select(*on, (F.col("_a") - F.col("_b")).alias(value)))


def placed_draws(draws: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, chain, value, ``_at`` (0-based place of the draw in its chain, gaps or not) and ``_len`` (draws of the chain)."""
    x = draws.select(F.struct(*keys, "chain").alias("_g"), "draw", F.col(value).alias("_v"))
    placed = dense_rank_by(x, "_g", "draw", "_at")
    size = placed.groupBy("_g").agg(F.count(F.lit(1)).alias("_len"))
    return placed.join(size, "_g").select("_g.*", F.col("_v").alias(value), "_at", "_len")


def split_rhat(draws: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Split-R-hat per group from per-half-chain means and variances.

    Chains are cut by place; the middle draw of an odd chain is in no half.
    """
    d = placed_draws(draws, keys, value)
    half = F.floor(F.col("_len") / 2)
    d = d.withColumn("_half", F.when(F.col("_at") < half, 0).when(F.col("_at") >= F.col("_len") - half, 1)).where("_half is not null")
    hc = d.groupBy(*keys, "chain", "_half").agg(F.count(F.lit(1)).alias("m"), F.avg(value).alias("mu"),
                                                F.var_samp(value).alias("s2"))
    g = hc.groupBy(*keys).agg(F.avg("m").alias("n"), F.var_samp("mu").alias("b_over_n"),
                              F.avg("s2").alias("w"), F.count(F.lit(1)).alias("n_half"))
    var_plus = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b_over_n")
    return g.select(*keys, "n_half", F.sqrt(F.try_divide(var_plus, F.col("w"))).alias("rhat"))


def batch_means_ess(draws: DataFrame, keys: Sequence[str], value: str = "value", n_batches: int = 20) -> DataFrame:
    """Effective sample size by batch means: n * var / (b * var(batch means)), b = batch length.

    Each chain is cut into ``n_batches`` batches by place; anticorrelated draws
    give more than n, as they should.
    """
    d = placed_draws(draws, keys, value).withColumn("_batch", F.floor(F.col("_at") * n_batches / F.col("_len")))
    bm = d.groupBy(*keys, "chain", "_batch").agg(F.avg(value).alias("mu"), F.count(F.lit(1)).alias("m"))
    tot = draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_samp(value).alias("v"))
    b = bm.groupBy(*keys).agg(F.var_samp("mu").alias("vb"), F.avg("m").alias("bl"))
    j = tot.join(b, list(keys), "inner")
    return j.select(*keys, "n", F.try_divide(F.col("n") * F.col("v"), F.col("bl") * F.col("vb")).alias("ess"))


# ---------------------------------------------------------------- rank-normalised diagnostics
def rank_diagnostics(draws: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Rank-normalised split R-hat (max of bulk and folded tail) and bulk ESS per parameter.

    One task for each parameter: for tables of many short groups.  ``rank_draws``
    holds the distributed form, which gives the same numbers.  Chains may differ in
    length; every draw counts.  The ESS may exceed the number of draws S, up to
    S * log10(S), as for anticorrelated draws.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    key_cols = list(keys)

    # helpers nested here so the worker function is shipped by value (no package import on workers)
    def _average_ranks(v):
        import numpy as np

        order = np.argsort(v, kind="mergesort")
        sv = v[order]
        _, first, counts = np.unique(sv, return_index=True, return_counts=True)
        avg = first + (counts + 1) / 2.0  # 1-based average rank of each run of ties
        ranks = np.empty(len(v))
        ranks[order] = np.repeat(avg, counts)
        return ranks


    def _rank_normal(seqs):
        """Rank-normalised chains (average ranks over all of them for ties)."""
        from statistics import NormalDist

        flat = np.concatenate(seqs)
        p = (_average_ranks(flat) - 0.375) / (len(flat) + 0.25)
        z = np.vectorize(NormalDist().inv_cdf)(p)
        return np.split(z, np.cumsum([len(s) for s in seqs])[:-1])

    def _split_chains(seqs):
        return [part for s in seqs for part in (s[:len(s) // 2], s[len(s) - len(s) // 2:]) if len(part) > 1]

    def _spread(halves):
        """Mean length, mean variance within, variance of the means."""
        n = float(np.mean([len(h) for h in halves]))
        w = float(np.mean([h.var(ddof=1) for h in halves]))
        return n, w, float(np.var([h.mean() for h in halves], ddof=1)) if len(halves) > 1 else 0.0

    def _rhat(halves):
        n, w, b = _spread(halves)
        return float(np.sqrt(((n - 1) / n * w + b) / w)) if w > 0 else None

    def _ess(halves):
        """Effective sample size with Geyer's initial monotone sequence (autocovariance by FFT)."""
        n, w, b = _spread(halves)
        total, longest = sum(map(len, halves)), max(map(len, halves))
        var_plus = w * (n - 1) / n + b
        if var_plus <= 0:
            return None
        acov, held = np.zeros(longest), np.zeros(longest)
        for h in halves:
            f = np.fft.rfft(h - h.mean(), n=2 * len(h))
            acov[:len(h)] += np.fft.irfft(f * np.conj(f))[:len(h)] / len(h)
            held[:len(h)] += 1
        rho = 1.0 - (w - acov / held) / var_plus
        rho[0] = 1.0
        pairs, before = 0.0, np.inf
        for k in range(0, longest - 1, 2):
            pair = min(rho[k] + rho[k + 1], before)
            if pair <= 0:
                break
            pairs, before = pairs + pair, pair
        tau = max(-1.0 + 2.0 * pairs, 1.0 / np.log10(max(total, 11)))
        return float(total / tau)

    def per_param(pdf: pd.DataFrame) -> pd.DataFrame:
        chains = sorted(pdf["chain"].unique())
        seqs = [pdf.loc[pdf["chain"] == c].sort_values("draw")[value].to_numpy(dtype=float) for c in chains]
        x = np.concatenate(seqs)
        middle = np.median(x)
        halves = _split_chains(_rank_normal(seqs))
        folded = _split_chains(_rank_normal([np.abs(s - middle) for s in seqs]))
        row = {k: pdf[k].iloc[0] for k in key_cols} | {"n_chains": len(chains), "n_draws": len(x), "rhat": None, "ess_bulk": None}
        if halves:
            both = [r for r in (_rhat(halves), _rhat(folded)) if r is not None]
            row.update(rhat=max(both) if both else None, ess_bulk=_ess(halves))
        return pd.DataFrame([row])

    schema = T.StructType([*[draws.schema[k] for k in key_cols], T.StructField("n_chains", T.LongType()),
                           T.StructField("n_draws", T.LongType()), T.StructField("rhat", T.DoubleType()),
                           T.StructField("ess_bulk", T.DoubleType())])
    return draws.select(*key_cols, "chain", "draw", value).groupBy(*key_cols).applyInPandas(per_param, schema)
