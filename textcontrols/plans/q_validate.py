"""Queries: key coverage, null guard, golden check against independent aggregates, fit worklist, draws diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from textcontrols.operators import validate as V
from textcontrols.functions.stats import NORMAL_CENTRE, NORMAL_FAR, NORMAL_TAIL
from textcontrols.operators.draws import batch_means_ess, draw_quantiles, paired_draw_diff, placed_draws, split_rhat
from textcontrols.operators.rank_draws import rank_ess, rank_rhat
from textcontrols.operators._util import materialize_small
from textcontrols.plans.q_models import FRAME_SQL, MODELS, Suite, _loo_sql, _looic, model_frame
from textcontrols.plans.q_recode import ANALYSIS_SQL, analysis_rows
from textcontrols.plans.registry import query
from textcontrols.sources.tables import load_table


@query("key_coverage", sql="""
WITH l AS (SELECT DISTINCT doc_id FROM documents), r AS (SELECT DISTINCT doc_id FROM labels)
SELECT CAST(count_if(r.doc_id IS NULL) AS BIGINT) AS n_left_only, CAST(count_if(l.doc_id IS NULL) AS BIGINT) AS n_right_only,
       CAST(count_if(l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL) AS BIGINT) AS n_both
FROM l FULL JOIN r ON l.doc_id = r.doc_id""")
def key_coverage(spark, sf):
    return V.key_coverage(load_table(spark, sf, "documents"), load_table(spark, sf, "labels"), "doc_id")


_NG_COLS = ["rating", "base_on_left", "Pref", "value"]


@query("null_guard", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null, "
    f"CAST(count_if(isnan({c})) AS BIGINT) AS n_nan FROM {ANALYSIS_SQL}" for c in _NG_COLS))
def null_guard(spark, sf):
    return V.null_counts(analysis_rows(spark, sf), _NG_COLS)


_GOLDEN_FITS = (("wc", "wc_diff"), ("controls_1", "INTN1"))


def _golden(spark, sf):
    """Golden estimates and errors from independent aggregates: plain cell means and Spark's regr_* functions.

    Two rows are wrong on purpose: a model the suite does not fit (MISSING) and
    an error that is off by 1 (MISMATCH).
    """
    f = model_frame(spark, sf)
    err = lambda var, nu: F.round(F.sqrt(var * nu / (nu - 2)), 3)
    per = (f.where(F.col("condition").isNotNull()).groupBy("experiment", "condition")
           .agg(F.avg("y").alias("m"), F.count("y").alias("n"), (F.var_samp("y") * (F.count("y") - 1)).alias("ss")))
    pool = per.groupBy("experiment").agg((F.sum("n") - F.count("n")).alias("nu"), F.sum("ss").alias("ss"))
    cells = per.drop("ss").join(pool, "experiment").select(
        "experiment", F.lit("oracle").alias("model"), F.col("condition").alias("parameter"), F.round("m", 3).alias("gt_est"),
        err(F.col("ss") / F.col("nu") / F.col("n"), F.col("nu")).alias("gt_se"))
    aggs = [(F.count(F.lit(1)) - 2).alias("nu"), F.count(F.lit(1)).alias("n")]
    for m, x in _GOLDEN_FITS:
        aggs += [F.regr_slope("y", x).alias(f"b_{m}"), F.regr_intercept("y", x).alias(f"a_{m}"), F.regr_sxx("y", x).alias(f"sxx_{m}"),
                 F.regr_avgx("y", x).alias(f"mx_{m}"), (F.regr_syy("y", x) - F.regr_slope("y", x) * F.regr_sxy("y", x)).alias(f"rss_{m}")]
    reg = f.groupBy("experiment").agg(*aggs)
    rows = []
    for m, x in _GOLDEN_FITS:
        s2 = F.col(f"rss_{m}") / F.col("nu")
        at_zero = s2 * (1.0 / F.col("n") + F.col(f"mx_{m}") * F.col(f"mx_{m}") / F.col(f"sxx_{m}"))
        rows.append(F.struct(F.lit(m).alias("model"), F.lit("Intercept").alias("parameter"), F.round(f"a_{m}", 3).alias("gt_est"),
                             err(at_zero, F.col("nu")).alias("gt_se")))
        rows.append(F.struct(F.lit(m).alias("model"), F.lit(x).alias("parameter"), F.round(f"b_{m}", 3).alias("gt_est"),
                             (err(s2 / F.col(f"sxx_{m}"), F.col("nu")) + (1.0 if m == "controls_1" else 0.0)).alias("gt_se")))
    rows.append(F.struct(F.lit("controls_3").alias("model"), F.lit("Intercept").alias("parameter"),
                         F.round("a_wc", 3).alias("gt_est"), F.lit(None).cast("double").alias("gt_se")))
    return cells.unionByName(reg.select("experiment", F.explode(F.array(*rows)).alias("_g")).select("experiment", "_g.*"))


def _golden_sql() -> str:
    err = lambda var, nu: f"round(sqrt({var} * {nu} / ({nu} - 2)), 3)"
    parts = [f"""SELECT p.experiment, 'oracle' AS model, p.condition AS parameter, round(p.m, 3) AS gt_est,
       {err('(q.ss / q.nu / p.n)', 'q.nu')} AS gt_se
  FROM (SELECT experiment, condition, avg(y) AS m, count(y) AS n FROM {FRAME_SQL} WHERE condition IS NOT NULL GROUP BY ALL) p
  JOIN (SELECT experiment, sum(n) - count(*) AS nu, sum(ss) AS ss FROM (SELECT experiment, condition, count(y) AS n,
          var_pop(y) * count(y) AS ss FROM {FRAME_SQL} WHERE condition IS NOT NULL GROUP BY ALL) GROUP BY experiment) q
    ON q.experiment = p.experiment"""]
    for m, x in _GOLDEN_FITS:
        g = f"""(SELECT experiment, count(*) AS n, count(*) - 2 AS nu, regr_slope(y, {x}) AS b, regr_intercept(y, {x}) AS a,
          regr_sxx(y, {x}) AS sxx, avg({x}) AS mx, (regr_syy(y, {x}) - regr_slope(y, {x}) * regr_sxy(y, {x})) / (count(*) - 2) AS s2
          FROM {FRAME_SQL} GROUP BY experiment)"""
        parts.append(f"SELECT experiment, '{m}', 'Intercept', round(a, 3), {err('(s2 * (1.0 / n + mx * mx / sxx))', 'nu')} FROM {g}")
        parts.append(f"SELECT experiment, '{m}', '{x}', round(b, 3), {err('(s2 / sxx)', 'nu')} + {1.0 if m == 'controls_1' else 0.0} FROM {g}")
        if m == "wc":
            parts.append(f"SELECT experiment, 'controls_3', 'Intercept', round(a, 3), NULL FROM {g}")
    return "(" + " UNION ALL ".join(parts) + ")"


_GOLDEN_SQL = _golden_sql()


def _suite_sql_for_golden():
    from textcontrols.plans.q_models import _suite_sql
    return _suite_sql(12)


_CHECK_SQL = f"""(SELECT g.experiment, g.model, g.parameter, g.gt_est, round(a.estimate, 3) AS estimate,
  CASE WHEN a.estimate IS NULL THEN 'MISSING' WHEN abs(round(a.estimate, 3) - g.gt_est) < {V.EST_TOL}
            AND (g.gt_se IS NULL OR abs(round(a.est_error, 3) - g.gt_se) < {V.EST_TOL}) THEN 'MATCH'
       ELSE 'MISMATCH' END AS status
FROM {_GOLDEN_SQL} g LEFT JOIN {_suite_sql_for_golden()} a
  ON a.experiment = g.experiment AND a.model = g.model AND a.parameter = g.parameter)"""


@query("golden_check", sql=f"SELECT * FROM {_CHECK_SQL}")
def golden_check(spark, sf):
    return V.golden_check(_golden(spark, sf), Suite(spark, sf).long(), ["experiment", "model", "parameter"])


@query("golden_summary", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS n_checked, CAST(count_if(status = 'MATCH') AS BIGINT) AS n_match,
       CAST(count_if(status = 'MISMATCH') AS BIGINT) AS n_mismatch, CAST(count_if(status = 'MISSING') AS BIGINT) AS n_missing,
       count(*) > 0 AND count_if(status = 'MATCH') = count(*) AS all_ok
FROM {_CHECK_SQL}""")
def golden_summary(spark, sf):
    return V.golden_summary(golden_check(spark, sf))


@query("golden_values", sql=f"""
WITH n AS (SELECT experiment, 'n' AS label, CAST(count(*) AS DOUBLE) AS value FROM {FRAME_SQL} GROUP BY experiment),
l AS (SELECT experiment, 'looic_' || model AS label, looic AS value FROM {_loo_sql()}),
actual AS (SELECT * FROM n UNION ALL SELECT * FROM l),
golden AS (SELECT experiment, label, round(value, 1) + CASE WHEN label = 'looic_wc' THEN 0.5 ELSE 0 END AS gt FROM actual
           UNION ALL SELECT experiment, 'looic_unknown', 0.0 FROM n)
SELECT g.experiment, g.label, g.gt, round(a.value, 1) AS value,
       CASE WHEN a.value IS NULL THEN 'MISSING' WHEN abs(round(a.value, 1) - g.gt) < {V.LOOIC_TOL} THEN 'MATCH' ELSE 'MISMATCH' END AS status
FROM golden g LEFT JOIN actual a ON a.experiment = g.experiment AND a.label = g.label""")
def golden_values(spark, sf):
    """Sample sizes and LOOIC against stored values: one shifted past the tolerance, one of an unknown model."""
    s = Suite(spark, sf)
    n = s.frame.groupBy("experiment").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("label", F.lit("n"))
    looic = _looic(s).select("experiment", F.concat(F.lit("looic_"), "model").alias("label"), F.col("looic").alias("value"))
    actual = materialize_small(n.select("experiment", "label", "value").unionByName(looic))
    shift = F.when(F.col("label") == "looic_wc", 0.5).otherwise(0.0)
    golden = actual.select("experiment", "label", (F.round("value", 1) + shift).alias("gt")).unionByName(
        n.select("experiment", F.lit("looic_unknown").alias("label"), F.lit(0.0).alias("gt")))
    out = V.golden_check_values(golden, actual, ["experiment", "label"])
    return out.withColumn("value", F.round("value", 1))


def _fingerprints(spark, sf):
    """Row count and an order-free checksum of every value that the models read: a changed value changes it."""
    li = load_table(spark, sf, "lineitem")
    read = ["l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("decimal(18,4)").cast("string") if c not in ("l_returnflag",) else F.col(c)
                                   for c in read]))
    part = lambda k: F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    fp = li.groupBy(F.col("l_linestatus").alias("experiment")).agg(
        F.concat_ws("-", F.count(F.lit(1)).cast("string"), *[F.sum(part(k)).cast("string") for k in (0, 1)]).alias("fingerprint"))
    models = F.explode(F.array(*[F.lit(m) for m in ["oracle", *MODELS]]))
    return fp.select("experiment", models.alias("model"), "fingerprint")


_ROW_SQL = "md5(concat_ws('|', " + ", ".join(
    "l_returnflag" if c == "l_returnflag" else f"CAST(CAST({c} AS DECIMAL(18,4)) AS VARCHAR)"
    for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax")) + "))"


def _part_sql(k: int) -> str:
    return f"CAST(sum(CAST(('0x' || substr({_ROW_SQL}, {8 * k + 1}, 8))::BIGINT AS HUGEINT)) AS VARCHAR)"


@query("fit_worklist", sql=f"""
WITH fp AS (SELECT l_linestatus AS experiment,
                   CAST(count(*) AS VARCHAR) || '-' || {_part_sql(0)} || '-' || {_part_sql(1)} AS fingerprint
            FROM lineitem GROUP BY l_linestatus),
w AS (SELECT experiment, m.model, fingerprint FROM fp,
      (SELECT unnest(['oracle', {', '.join(repr(m) for m in MODELS)}]) AS model) m),
cache AS (SELECT experiment, model, fingerprint FROM w WHERE experiment = 'F' AND model <> 'controls_2'
          UNION ALL SELECT experiment, model, 'stale' FROM w WHERE experiment = 'O')
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.experiment = w.experiment
                                   AND c.model = w.model AND c.fingerprint = w.fingerprint)""")
def fit_worklist(spark, sf):
    w = _fingerprints(spark, sf)
    cache = (w.where((F.col("experiment") == "F") & (F.col("model") != "controls_2"))
             .unionByName(w.where(F.col("experiment") == "O").withColumn("fingerprint", F.lit("stale"))))
    return V.fit_worklist(w, cache, ["experiment", "model"])


def _draws(spark, sf):
    """events as a draws table: parameter = event_type, chain = user_id mod 4, draw = event_id."""
    e = load_table(spark, sf, "events")
    return e.select(F.col("event_type").alias("parameter"), F.pmod("user_id", F.lit(4)).alias("chain"),
                    F.col("event_id").alias("draw"), "value")


_DRAWS_SQL = "(SELECT event_type AS parameter, user_id % 4 AS chain, event_id AS draw, value FROM events)"
_PLACED_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY parameter, chain ORDER BY draw) - 1 AS place,
  count(*) OVER (PARTITION BY parameter, chain) AS len FROM {_DRAWS_SQL})"""


@query("draws_rhat", sql=f"""
WITH hc AS (SELECT parameter, chain, place >= len - len // 2 AS half, count(*) AS m, avg(value) AS mu, var_samp(value) AS s2
            FROM {_PLACED_SQL} WHERE place < len // 2 OR place >= len - len // 2 GROUP BY ALL),
g AS (SELECT parameter, avg(m) AS n, var_samp(mu) AS b_over_n, avg(s2) AS w, count(*) AS n_half FROM hc GROUP BY parameter)
SELECT parameter, CAST(n_half AS BIGINT) AS n_half, round(sqrt(((n - 1) / n * w + b_over_n) / w), 6) AS rhat FROM g""")
def draws_rhat(spark, sf):
    return split_rhat(_draws(spark, sf), ["parameter"], "value").withColumn("rhat", F.round("rhat", 6))


@query("draws_ess", sql=f"""
WITH bm AS (SELECT parameter, chain, place * 20 // len AS batch, avg(value) AS mu, count(*) AS m FROM {_PLACED_SQL} GROUP BY ALL),
bb AS (SELECT parameter, var_samp(mu) AS vb, avg(m) AS bl FROM bm GROUP BY parameter),
t AS (SELECT parameter, count(*) AS n, var_samp(value) AS v FROM {_DRAWS_SQL} GROUP BY parameter)
SELECT t.parameter, CAST(t.n AS BIGINT) AS n, round(t.n * t.v / (bb.bl * bb.vb), 2) AS ess
FROM t JOIN bb ON bb.parameter = t.parameter""")
def draws_ess(spark, sf):
    return batch_means_ess(_draws(spark, sf), ["parameter"], "value").withColumn("ess", F.round("ess", 2))


def _horner(row, r):
    text = repr(row[0]) + "::DOUBLE"
    for c in row[1:]:
        text = f"({text} * {r} + {c!r}::DOUBLE)"
    return text


def _ratio_sql(coefficients, r):
    return f"({_horner(coefficients[0], r)} / {_horner(coefficients[1], r)})"


def _scores_sql(name, table, value):
    """CTEs ``name``: the rows of ``table`` with ``z``, the normal scores of the average ranks of ``value`` by parameter."""
    return f"""{name}_r AS (SELECT *, (rank() OVER (PARTITION BY parameter ORDER BY {value}) + (count(*) OVER (PARTITION BY parameter, {value}) - 1) / 2.0 - 0.375)
    / (count(*) OVER (PARTITION BY parameter) + 0.25) - 0.5 AS q FROM {table}),
{name}_t AS (SELECT *, 0.180625 - q * q AS r, sqrt(-ln(CASE WHEN q <= 0 THEN q + 0.5 ELSE 0.5 - q END)) AS tail FROM {name}_r),
{name} AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio_sql(NORMAL_CENTRE, "r")}
    ELSE sign(q) * CASE WHEN tail <= 5 THEN {_ratio_sql(NORMAL_TAIL, "(tail - 1.6)")} ELSE {_ratio_sql(NORMAL_FAR, "(tail - 5)")} END END AS z,
    place >= len - len // 2 AS half FROM {name}_t)"""


def _spread_sql(name, table):
    return f"""{name}_h AS (SELECT parameter, chain, half, count(*) AS m, avg(z) AS mu, var_samp(z) AS s2 FROM {table}
    WHERE len // 2 > 1 AND (place < len // 2 OR half) GROUP BY ALL),
{name} AS (SELECT parameter, avg(m) AS n, avg(s2) AS w, coalesce(var_samp(mu), 0) AS b, sum(m) AS total, max(m) AS longest FROM {name}_h GROUP BY parameter)"""


@query("draws_rank_rhat", sql=f"""
WITH p AS {_PLACED_SQL},
mid AS (SELECT parameter, quantile_cont(value, 0.5) AS middle FROM p GROUP BY parameter),
f AS (SELECT p.parameter, chain, place, len, abs(value - middle) AS value FROM p JOIN mid ON mid.parameter = p.parameter),
{_scores_sql("bulk", "p", "value")}, {_scores_sql("tail", "f", "value")}, {_spread_sql("sb", "bulk")}, {_spread_sql("st", "tail")},
c AS (SELECT parameter, count(DISTINCT chain) AS n_chains, count(*) AS n_draws FROM p GROUP BY parameter)
SELECT c.parameter, n_chains, n_draws,
       round(greatest(sqrt(((sb.n - 1) / sb.n * sb.w + sb.b) / sb.w), sqrt(((st.n - 1) / st.n * st.w + st.b) / st.w)), 6) AS rhat
FROM c JOIN sb ON sb.parameter = c.parameter JOIN st ON st.parameter = c.parameter""")
def draws_rank_rhat(spark, sf):
    return rank_rhat(_draws(spark, sf), ["parameter"]).withColumn("rhat", F.round("rhat", 6))


@query("draws_rank_ess", sql=f"""
WITH p AS {_PLACED_SQL}, {_scores_sql("bulk", "p", "value")}, {_spread_sql("sb", "bulk")},
x AS (SELECT parameter, chain, half, CASE WHEN half THEN place - (len - len // 2) ELSE place END AS place, len // 2 AS held,
             z - avg(z) OVER (PARTITION BY parameter, chain, half) AS x FROM bulk WHERE len // 2 > 1 AND (place < len // 2 OR half)),
s AS (SELECT a.parameter, a.chain, a.half, a.held, b.place - a.place AS lag, sum(a.x * b.x) AS s
      FROM x a JOIN x b ON b.parameter = a.parameter AND b.chain = a.chain AND b.half = a.half AND b.place >= a.place GROUP BY ALL),
m AS (SELECT parameter, lag, avg(s / held) AS acov FROM s GROUP BY parameter, lag),
rho AS (SELECT m.parameter, lag, CASE WHEN lag = 0 THEN 1.0 ELSE 1 - (w - acov) / (w * (n - 1) / n + b) END AS rho
        FROM m JOIN sb ON sb.parameter = m.parameter),
pairs AS (SELECT parameter, lag // 2 AS k, sum(rho) AS pair FROM rho GROUP BY parameter, lag // 2 HAVING count(*) = 2),
falling AS (SELECT parameter, k, pair, min(pair) OVER (PARTITION BY parameter ORDER BY k ROWS UNBOUNDED PRECEDING) AS least FROM pairs),
kept AS (SELECT parameter, sum(least) AS pairs FROM falling WHERE least > 0 GROUP BY parameter),
c AS (SELECT parameter, count(DISTINCT chain) AS n_chains, count(*) AS n_draws FROM p GROUP BY parameter)
SELECT c.parameter, n_chains, n_draws, round(total / greatest(2 * coalesce(pairs, 0) - 1, 1 / log10(greatest(total, 11))), 2) AS ess_bulk
FROM c JOIN sb ON sb.parameter = c.parameter LEFT JOIN kept ON kept.parameter = c.parameter""")
def draws_rank_ess(spark, sf):
    return rank_ess(_draws(spark, sf), ["parameter"]).withColumn("ess_bulk", F.round("ess_bulk", 2))


@query("draws_paired_diff", sql=f"""
WITH d AS (SELECT parameter, chain, place, value FROM {_PLACED_SQL}),
x AS (SELECT a.value - b.value AS v FROM d a JOIN d b ON a.chain = b.chain AND a.place = b.place
      WHERE a.parameter = 'click' AND b.parameter = 'view')
SELECT 'click-view' AS comparison, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS q025,
       round(quantile_cont(v, 0.5), 6) AS q500, round(quantile_cont(v, 0.975), 6) AS q975 FROM x""")
def draws_paired_diff(spark, sf):
    """Draw by draw differences of two parameters of a draws table, with their quantiles."""
    d = placed_draws(_draws(spark, sf), ["parameter"], "value").withColumnRenamed("_at", "draw")
    a, b = (d.where(F.col("parameter") == p).select("chain", "draw", "value") for p in ("click", "view"))
    diff = paired_draw_diff(a, b, []).withColumn("comparison", F.lit("click-view"))
    q = draw_quantiles(diff, ["comparison"], "value")
    return q.select("comparison", "n", *[F.round(c, 6).alias(c) for c in ("mean", "q025", "q500", "q975")])
