"""Queries: the model family (cell means, pooled effect, OLS with controls, LOO, summaries).

Model frame from ``lineitem``: experiment = l_linestatus, condition =
l_returnflag (levels A, N, R with roles matched / short / long), outcome y =
l_extendedprice / 1000, word-count-like control = l_quantity, controls INTN1 =
l_discount and INTN2 = l_tax.  The flagship regression runs on conversation
pairs: answer length on prompt length per base turn.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textcontrols.operators import regress as R
from textcontrols.operators._util import bounded_broadcast, materialize_small
from textcontrols.plans.q_text import CONV_PAIRS_SQL, paired_word_counts
from textcontrols.plans.frames import conversation_word_counts
from textcontrols.plans.registry import query
from textcontrols.plans.sql_models import cell_wide_sql, interval_cols, ols3_long_sql, ols_long_sql, ols_wide_sql
from textcontrols.plans.sqltext import wc
from textcontrols.sources.tables import load_table

# Fixed parameters of the lineitem model frame.
LEVELS = ("A", "N", "R")
ROLES = {"A": "matched", "N": "short", "R": "long"}
KEYS = ["experiment"]
CONTROLS_1 = ["INTN1"]
CONTROLS_2 = ["INTN1", "INTN2"]
MODELS = {"wc": ["wc_diff"], "controls_1": CONTROLS_1, "controls_2": CONTROLS_2}

FRAME_SQL = """(SELECT l_linestatus AS experiment,
       CASE WHEN l_returnflag IN ('A', 'N', 'R') THEN l_returnflag END AS condition,
       l_extendedprice / 1000.0 AS y, l_quantity AS wc_diff, l_discount AS INTN1, l_tax AS INTN2
FROM lineitem)"""


def model_frame(spark, sf):
    li = load_table(spark, sf, "lineitem")
    cond = F.when(F.col("l_returnflag").isin(list(LEVELS)), F.col("l_returnflag"))
    return li.select(F.col("l_linestatus").alias("experiment"), cond.alias("condition"),
                     (F.col("l_extendedprice") / 1000.0).alias("y"), F.col("l_quantity").alias("wc_diff"),
                     F.col("l_discount").alias("INTN1"), F.col("l_tax").alias("INTN2"))


def _rounded(df, d=4, cols=("estimate", "est_error", "q_lo", "q_hi")):
    return df.select(*[F.round(c, d).alias(c) if c in cols else F.col(c) for c in df.columns])


class Suite:
    """All moments of the suite from one aggregate over (experiment, condition), each model on its complete cases."""

    COLUMNS = {"oracle": ["y"], **{m: ["y", *xs] for m, xs in MODELS.items()}}

    def __init__(self, spark, sf):
        self.frame = model_frame(spark, sf)
        # one aggregate over the rows, written: every model below reads this small table
        self.moments = materialize_small(R.group_moments_multi(self.frame, [*KEYS, "condition"], self.COLUMNS))
        self.cmw = R.cell_mean_wide(self.cells("oracle"), KEYS, "condition", "y")

    def cells(self, model):
        return R.moments_of(self.moments, [*KEYS, "condition"], model, self.COLUMNS[model])

    def groups(self, model):
        return R.combine_moments(self.cells(model), KEYS, self.COLUMNS[model])

    def wide(self, model):
        return R.ols_wide(self.groups(model), KEYS, "y", MODELS[model])

    def long(self):
        parts = [R.cell_mean_long(self.cmw, KEYS, "condition", "oracle")]
        parts += [R.ols_long(self.wide(m), KEYS, xs, m) for m, xs in MODELS.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


# ---------------------------------------------------------------- cell means
CELL_SQL = cell_wide_sql(FRAME_SQL, KEYS, "condition", "y")


@query("cell_mean_model", sql=f"""
SELECT experiment, condition, n AS n_cell, nu, {interval_cols('mean', 's2 / n', 'nu', 4)} FROM {CELL_SQL}""")
def cell_mean_model(spark, sf):
    s = Suite(spark, sf)
    return _rounded(s.cmw.select("experiment", "condition", F.col("n").alias("n_cell"), "nu",
                                 *R.with_interval(F.col("mean"), F.col("s2") / F.col("n"), F.col("nu"))))


@query("pooled_effect", sql=f"""
SELECT experiment, n, nu, {interval_cols('est', 's2 / n', 'nu', 4)}
FROM (SELECT experiment, CAST(sum(n) AS BIGINT) AS n, sum(n * mean) / sum(n) AS est, first(nu) AS nu,
             first(s2) AS s2 FROM {CELL_SQL} GROUP BY experiment)""")
def pooled_effect(spark, sf):
    return _rounded(R.pooled_effect(Suite(spark, sf).cmw, KEYS))


@query("pooled_diagnostic", sql=f"""
SELECT s.experiment, round(s.sample_mean, 6) AS sample_mean, round(p.pooled_mean, 6) AS pooled_mean
FROM (SELECT experiment, avg(y) AS sample_mean FROM {FRAME_SQL} GROUP BY experiment) s
JOIN (SELECT experiment, sum(n * mean) / sum(n) AS pooled_mean FROM {CELL_SQL} GROUP BY experiment) p
  ON p.experiment = s.experiment""")
def pooled_diagnostic(spark, sf):
    s = Suite(spark, sf)
    pooled = s.cmw.groupBy("experiment").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("pooled_mean"))
    sample = s.groups("oracle").select("experiment", F.col("m__y").alias("sample_mean"))
    return sample.join(pooled, "experiment").select(
        "experiment", F.round("sample_mean", 6).alias("sample_mean"), F.round("pooled_mean", 6).alias("pooled_mean"))


# ---------------------------------------------------------------- regressions
CONV_FRAME_SQL = f"""(SELECT turn, CAST({wc('Text_Comparison')} AS DOUBLE) AS wc_comparison,
       CAST({wc('Text_Base')} AS DOUBLE) AS wc_base FROM {CONV_PAIRS_SQL})"""


@query("ols_one_control", sql=f"""
SELECT * FROM {ols_long_sql(CONV_FRAME_SQL, ['turn'], 'wc_comparison', ['wc_base'], 'wc')}""")
def ols_one_control(spark, sf):
    pairs = paired_word_counts(conversation_word_counts(spark, sf))
    return _rounded(R.fit_ols(pairs, ["turn"], "wc_comparison", ["wc_base"], "wc"))


@query("ols_multi_control", sql=f"""
SELECT * FROM {ols_long_sql(FRAME_SQL, KEYS, 'y', CONTROLS_2, 'controls_2')}""")
def ols_multi_control(spark, sf):
    return _rounded(R.fit_ols(model_frame(spark, sf), KEYS, "y", CONTROLS_2, "controls_2"))


SUITE_SQL = (f"""(SELECT experiment, 'oracle' AS model, condition AS parameter, n_total AS n, nu,
  mean AS estimate_raw, s2 / n AS var_raw FROM {CELL_SQL})""")


def _suite_sql(d=4):
    cell = (f"SELECT experiment, 'oracle' AS model, condition AS parameter, n_total AS n, nu, "
            f"{interval_cols('mean', 's2 / n', 'nu', d)} FROM {CELL_SQL}")
    parts = [cell] + [f"SELECT * FROM {ols_long_sql(FRAME_SQL, KEYS, 'y', xs, m, d)}" for m, xs in MODELS.items()]
    return "(" + " UNION ALL ".join(parts) + ")"


@query("model_suite", sql=f"SELECT * FROM {_suite_sql()}")
def model_suite(spark, sf):
    return _rounded(Suite(spark, sf).long())


# ---------------------------------------------------------------- derived summaries
def _estimators(s: Suite):
    """experiment, estimator, estimate, est_error, q_lo, q_hi (unrounded)."""
    role = F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.lit("oracle_" + v))])
    cells = s.cmw.select("experiment", F.element_at(role, F.col("condition")).alias("estimator"),
                         *R.with_interval(F.col("mean"), F.col("s2") / F.col("n"), F.col("nu")))
    pooled = R.pooled_effect(s.cmw, KEYS).select("experiment", F.lit("naive_pooled").alias("estimator"),
                                                 "estimate", "est_error", "q_lo", "q_hi")
    out = cells.unionByName(pooled)
    for m, xs in MODELS.items():
        lg = R.ols_long(s.wide(m), KEYS, xs, m).where(F.col("parameter") == "Intercept")
        out = out.unionByName(lg.select("experiment", F.lit(m).alias("estimator"),
                                        "estimate", "est_error", "q_lo", "q_hi"))
    return out


def _estimators_sql(d=3):
    role_case = "CASE condition " + " ".join(f"WHEN '{k}' THEN 'oracle_{v}'" for k, v in ROLES.items()) + " END"
    parts = [f"SELECT experiment, {role_case} AS estimator, {interval_cols('mean', 's2 / n', 'nu', d)} FROM {CELL_SQL}",
             f"""SELECT experiment, 'naive_pooled' AS estimator, {interval_cols('est', 's2 / n', 'nu', d)}
                 FROM (SELECT experiment, sum(n) AS n, sum(n * mean) / sum(n) AS est, first(nu) AS nu,
                       first(s2) AS s2 FROM {CELL_SQL} GROUP BY experiment)"""]
    for m, xs in MODELS.items():
        parts.append(f"SELECT experiment, '{m}' AS estimator, {interval_cols('b0', 's2 * v_0_0', 'nu', d)} "
                     f"FROM {ols_wide_sql(FRAME_SQL, KEYS, 'y', xs)}")
    return "(" + " UNION ALL ".join(parts) + ")"


@query("posterior_summary", sql=f"SELECT * FROM {_estimators_sql(3)}")
def posterior_summary(spark, sf):
    return _rounded(_estimators(Suite(spark, sf)), 3)


@query("summary_table", sql=f"""
SELECT estimator,
  max(CASE WHEN experiment = 'F' THEN printf('%.3f [%.3f, %.3f]', estimate, q_lo, q_hi) END) AS exp_F,
  max(CASE WHEN experiment = 'O' THEN printf('%.3f [%.3f, %.3f]', estimate, q_lo, q_hi) END) AS exp_O
FROM {_estimators_sql(3)} GROUP BY estimator""")
def summary_table(spark, sf):
    from textcontrols.operators.report import summary_table as st
    est = _rounded(_estimators(Suite(spark, sf)), 3)
    return st(est, "estimator", "experiment", prefix="exp_")


@query("predict_at_means", sql=f"""
SELECT c.experiment, c.condition, round(c.wc_mean, 6) AS wc_mean,
       {interval_cols('b0 + b1 * c.wc_mean', 's2 * (v_0_0 + 2 * c.wc_mean * v_0_1 + c.wc_mean * c.wc_mean * v_1_1)', 'nu', 4)}
FROM (SELECT experiment, condition, avg(wc_diff) AS wc_mean FROM {FRAME_SQL} WHERE condition IS NOT NULL
      GROUP BY experiment, condition) c
JOIN {ols_wide_sql(FRAME_SQL, KEYS, 'y', ['wc_diff'])} w ON w.experiment = c.experiment""")
def predict_at_means(spark, sf):
    s = Suite(spark, sf)
    pts = s.cells("wc").where(F.col("condition").isNotNull()).select("experiment", "condition",
                                                              F.col("m__wc_diff").alias("wc_diff"))
    out = R.predict_at(s.wide("wc"), KEYS, pts, "wc_diff")
    return _rounded(out.select("experiment", "condition", F.round("wc_diff", 6).alias("wc_mean"),
                               "estimate", "est_error", "q_lo", "q_hi"))


@query("posterior_diff", sql=f"""
SELECT a.experiment, a.estimator || '-oracle_matched' AS comparison,
       round(a.estimate - b.estimate, 4) AS delta, round(sqrt(a.est_error * a.est_error + b.est_error * b.est_error), 4) AS se
FROM {_estimators_sql(12)} a JOIN {_estimators_sql(12)} b ON a.experiment = b.experiment
WHERE b.estimator = 'oracle_matched' AND a.estimator IN ('wc', 'controls_1', 'controls_2')""")
def posterior_diff(spark, sf):
    from textcontrols.operators.draws import posterior_diff_closed
    e = _estimators(Suite(spark, sf))
    return posterior_diff_closed(e, ["experiment"], "estimator", ["wc", "controls_1", "controls_2"], "oracle_matched")


def _loo_sql():
    parts = []
    for m, xs in MODELS.items():
        w = ols_wide_sql(FRAME_SQL, KEYS, "y", xs)
        if len(xs) == 1:
            h = f"1.0 / w.n + (d.{xs[0]} - w.m1) * (d.{xs[0]} - w.m1) * w.v_1_1"
            fit = f"w.b0 + w.b1 * d.{xs[0]}"
        else:
            h = (f"1.0 / w.n + (d.{xs[0]} - w.m1) * (d.{xs[0]} - w.m1) * w.v_1_1 + (d.{xs[1]} - w.m2) * (d.{xs[1]} - w.m2) * w.v_2_2"
                 f" + 2 * (d.{xs[0]} - w.m1) * (d.{xs[1]} - w.m2) * w.v_1_2")
            fit = f"w.b0 + w.b1 * d.{xs[0]} + w.b2 * d.{xs[1]}"
        p = len(xs) + 1
        parts.append(f"""SELECT d.experiment, '{m}' AS model, d.y - ({fit}) AS e, {h} AS h, w.rss AS rss,
                         CAST(w.n - 1 - {p} AS DOUBLE) AS nu1 FROM {FRAME_SQL} d JOIN {w} w ON w.experiment = d.experiment""")
    parts.append(f"""SELECT d.experiment, 'oracle' AS model, d.y - c.mean AS e, 1.0 / c.n AS h, c.s2 * c.nu AS rss,
                     CAST(c.nu - 1 AS DOUBLE) AS nu1 FROM {FRAME_SQL} d JOIN {CELL_SQL} c
                     ON c.experiment = d.experiment AND c.condition = d.condition""")
    rows = " UNION ALL ".join(parts)
    elpd = ("CASE WHEN h < 1 - 1e-12 AND nu1 >= 1 THEN lgamma((nu1 + 1) / 2) - lgamma(nu1 / 2)"
            " - 0.5 * (ln(nu1) + ln(pi()) + ln(sc2)) - (nu1 + 1) / 2 * ln(1 + r * r / (nu1 * sc2)) END")
    return f"""(SELECT experiment, model, -2.0 * sum(elpd) AS looic, CAST(count_if(elpd IS NULL) AS BIGINT) AS n_undefined
  FROM (SELECT experiment, model, {elpd} AS elpd
        FROM (SELECT *, e / (1 - h) AS r, (rss - e * e / (1 - h)) / nu1 / (1 - h) AS sc2 FROM ({rows})))
  GROUP BY experiment, model)"""


def _looic(s: Suite):
    """LOOIC of the four models in two passes over the rows.

    The regression fits form one small table (one row per experiment,
    prefixed columns) and the cell fits another; both are written once and
    broadcast.  The three regressions share one pass; the cell model runs in a
    second pass (all four in one generated stage exceed the code-size limits
    of whole-stage codegen and fall back to a much slower path).
    """
    fits = None
    for m, xs in MODELS.items():  # one row per experiment
        one = R.prefixed(R.loo_constants(s.wide(m), len(xs) + 1), KEYS, f"_{m}_")
        fits = one if fits is None else fits.join(one, KEYS, "full")
    cells = materialize_small(R.prefixed(R.loo_constants(s.cmw), [*KEYS, "condition"], "_oracle_"))

    fits_b, _ = bounded_broadcast(fits)  # one row per experiment: counted, then broadcast
    rows = s.frame.join(fits_b, KEYS, "inner")
    for m, xs in MODELS.items():
        rows = R.add_loo_elpd(rows, "y", xs, f"_{m}_", f"elpd__{m}")
    reg = rows.groupBy(*KEYS).agg(*[x for m in MODELS for x in (
        (-2.0 * F.sum(f"elpd__{m}")).alias(f"looic__{m}"),
        F.count_if(F.col(f"elpd__{m}").isNull() & R.complete(s.COLUMNS[m])).alias(f"undef__{m}"))])

    cells_b, _ = bounded_broadcast(cells)  # one row per cell: counted, then broadcast
    crow = s.frame.where(F.col("condition").isNotNull() & R.complete(["y"])).join(cells_b, [*KEYS, "condition"], "inner")
    crow = R.add_loo_elpd(crow, "y", None, "_oracle_", "elpd__oracle")
    cel = crow.groupBy(*KEYS).agg((-2.0 * F.sum("elpd__oracle")).alias("looic__oracle"),
                                  F.count_if(F.col("elpd__oracle").isNull()).alias("undef__oracle"))
    g = reg.join(cel, KEYS, "full")
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"looic__{m}").alias("looic"),
                                        F.col(f"undef__{m}").alias("n_undefined")) for m in ["oracle", *MODELS]]))
    return g.select(*KEYS, long.alias("_l")).select(*KEYS, "_l.*")


@query("looic", sql=f"SELECT experiment, model, round(looic, 2) AS looic, n_undefined FROM {_loo_sql()}")
def looic_q(spark, sf):
    return _looic(Suite(spark, sf)).withColumn("looic", F.round("looic", 2))


@query("model_compare", sql=f"""
SELECT experiment, arg_min(model, looic) AS best_model,
       round(max(CASE WHEN model = 'controls_1' THEN looic END) - max(CASE WHEN model = 'controls_2' THEN looic END), 2) AS looic_diff_1_2
FROM {_loo_sql()} GROUP BY experiment""")
def model_compare(spark, sf):
    lo = _looic(Suite(spark, sf))
    return lo.groupBy("experiment").agg(
        F.min_by("model", "looic").alias("best_model"),
        F.round(F.max(F.when(F.col("model") == "controls_1", F.col("looic")))
                - F.max(F.when(F.col("model") == "controls_2", F.col("looic"))), 2).alias("looic_diff_1_2"))


@query("ols_general", sql="SELECT * FROM " + ols3_long_sql(FRAME_SQL, KEYS, "y", ["wc_diff", *CONTROLS_2],
                                                          "wc_controls_2"))
def ols_general_q(spark, sf):
    """``y ~ 1 + wc_diff + INTN1 + INTN2`` per experiment: more regressors than the column closed form."""
    return _rounded(R.fit_ols(model_frame(spark, sf), KEYS, "y", ["wc_diff", *CONTROLS_2], "wc_controls_2"))


# ---------------------------------------------------------------- complete cases and rank
NULLS = ["y", "wc_diff", "INTN1"]
NULL_SQL = """(SELECT l_linestatus AS experiment,
       CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice / 1000.0 END AS y,
       CASE WHEN l_linenumber <> 3 THEN l_quantity END AS wc_diff,
       CASE WHEN l_partkey % 5 <> 0 THEN l_discount ELSE CAST('NaN' AS DOUBLE) END AS INTN1, l_tax AS INTN2,
       3.0 * l_tax + 0.1 AS twin, 1.0 AS flat
FROM lineitem)"""


def null_frame(spark, sf):
    """The model frame with missing cells, a copy of a control on another scale and a constant."""
    li = load_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_linestatus").alias("experiment"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice") / 1000.0).alias("y"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("wc_diff"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("INTN1"),
        F.col("l_tax").alias("INTN2"), (F.col("l_tax") * 3.0 + 0.1).alias("twin"), F.lit(1.0).alias("flat"))


def _complete_sql(cols):
    return f"(SELECT * FROM {NULL_SQL} WHERE " + " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}::DOUBLE)" for c in cols) + ")"


@query("ols_with_nulls", sql=" UNION ALL ".join([
    "SELECT * FROM " + ols_long_sql(_complete_sql(["y", "wc_diff"]), KEYS, "y", ["wc_diff"], "one"),
    "SELECT * FROM " + ols_long_sql(_complete_sql(NULLS), KEYS, "y", ["wc_diff", "INTN1"], "two"),
    "SELECT * FROM " + ols3_long_sql(_complete_sql([*NULLS, "INTN2"]), KEYS, "y", ["wc_diff", "INTN1", "INTN2"], "three")]))
def ols_with_nulls(spark, sf):
    f = null_frame(spark, sf)
    fits = [R.fit_ols(f, KEYS, "y", xs, m) for m, xs in
            (("one", ["wc_diff"]), ("two", ["wc_diff", "INTN1"]), ("three", ["wc_diff", "INTN1", "INTN2"]))]
    return _rounded(fits[0].unionByName(fits[1]).unionByName(fits[2]))


_COLLINEAR = (("flat", ["flat"]), ("twins", ["INTN2", "twin"]), ("three", ["wc_diff", "INTN2", "twin"]))


@query("ols_collinear", sql=" UNION ALL ".join(
    f"SELECT experiment, '{m}' AS model, '{x}' AS parameter, CAST(count(*) AS BIGINT) AS n, "
    f"CAST(count(*) - {len(xs) + 1} AS BIGINT) AS nu, CAST(NULL AS DOUBLE) AS estimate, CAST(NULL AS DOUBLE) AS est_error, "
    f"CAST(NULL AS DOUBLE) AS q_lo, CAST(NULL AS DOUBLE) AS q_hi FROM {_complete_sql(['y', *xs])} GROUP BY experiment"
    for m, xs in _COLLINEAR for x in ["Intercept", *xs]))
def ols_collinear(spark, sf):
    """A constant, a control given twice: no estimate, whichever way the model is solved."""
    f = null_frame(spark, sf)
    fits = [R.fit_ols(f, KEYS, "y", xs, m) for m, xs in _COLLINEAR]
    return _rounded(fits[0].unionByName(fits[1]).unionByName(fits[2]))
