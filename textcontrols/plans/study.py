"""A study end to end: survey export + control table -> enriched rows -> analysis rows -> models.

The same chain as the registered queries, on a user's own inputs:

1. ``enrich_survey``: read the raw export (metadata rows removed), match the
   base and comparison texts to the control table (ordered matching), attach
   ``INTN_k(comparison) - INTN_k(base)``, the matched flag and word counts;
2. ``analysis_rows``: keep complete responses, recode the preference, drop
   missing preference / condition, keep matched rows, factor the condition
   (values outside the levels stay as null), recompute word-count differences;
3. ``fit_suite``: per experiment the cell-mean model and the word-count and
   control regressions with t intervals, the pooled effect and LOOIC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcontrols.functions.recode import control_columns, factor_level, lenient_bool, lenient_double, reverse_score
from textcontrols.functions.text import word_count
from textcontrols.operators import regress as R
from textcontrols.operators._util import materialize_small
from textcontrols.operators.match import build_lookup, enrich_pairs
from textcontrols.sources.survey import read_survey_csv


# Column names and the 7-point scale of the survey export; callers with others rename or pass them.
COMPLETE_COL, RATING_COL, FLAG_COL, CONDITION_COL = "Q_TerminateFlag", "DVPref_Rating_1", "BaseOnLeft", "ComparisonCondition"
SCALE_MAX, SCALE_CENTRE = 7, 4


def enrich_survey(spark: SparkSession, survey_path: str, controls: DataFrame, text_col: str = "description",
                  pos_col: str = "position", base_col: str = "Text_Base", comp_col: str = "Text_Comparison",
                  experiment: str | None = None) -> DataFrame:
    """Raw survey rows with INTN1..k differences, ``nuisance_matched`` and word counts.

    ``pos_col`` gives the control table's row order (the first key in that
    order wins a containment tie).
    """
    ctrl = control_columns(controls.columns)
    lookup = build_lookup(controls, text_col, pos_col, ctrl)
    raw = read_survey_csv(spark, survey_path)
    if experiment is not None:
        raw = raw.withColumn("experiment", F.lit(experiment))
    return enrich_pairs(raw, base_col, comp_col, lookup, len(ctrl))


def analysis_rows(enriched: DataFrame, levels: Sequence[str], complete: str = "Complete",
                  scale_max: int = SCALE_MAX, centre: int = SCALE_CENTRE) -> DataFrame:
    """Filters and recodes of the analysis step, in order; factor values outside ``levels`` -> null, kept."""
    d = enriched.where(F.col(COMPLETE_COL) == complete)
    rating, flag = lenient_double(RATING_COL), lenient_double(FLAG_COL)
    d = d.withColumn("Pref", reverse_score(flag, rating, scale_max, centre))
    d = d.where(F.col("Pref").isNotNull() & ~F.isnan("Pref") & F.col(CONDITION_COL).isNotNull()
                & (F.col(CONDITION_COL) != ""))
    matched = F.col("nuisance_matched")
    if dict(d.dtypes)["nuisance_matched"] != "boolean":
        matched = lenient_bool("nuisance_matched")
    d = d.where(F.coalesce(matched, F.lit(False)))
    d = d.withColumn("condition", factor_level(CONDITION_COL, levels))
    d = d.withColumn("wc_base", word_count("Text_Base")).withColumn("wc_comparison", word_count("Text_Comparison"))
    d = d.withColumn("wc_diff", F.col("wc_comparison") - F.col("wc_base"))
    return d.withColumn("wc2_diff", F.col("wc_comparison") * F.col("wc_comparison")
                        - F.col("wc_base") * F.col("wc_base"))


def fit_suite(d: DataFrame, keys: Sequence[str] = ("experiment",), controls: Sequence[str] = ("INTN1", "INTN2"),
              y: str = "Pref") -> dict[str, DataFrame]:
    """Model table (long), pooled effect and LOOIC per experiment.

    Models: ``oracle`` (cell means, pooled sigma), ``wc`` (y ~ 1 + wc_diff) and,
    for each k up to the number of controls, ``controls_k`` (y ~ 1 + the first k).
    Each model is fitted on its own complete cases.
    """
    keys = list(keys)
    cols = [y, "wc_diff", *controls]
    frame = d.select(*keys, "condition", *[F.col(c).cast("double").alias(c) for c in cols])
    models = {"wc": ["wc_diff"], **{f"controls_{k}": list(controls[:k]) for k in range(1, len(controls) + 1)}}
    columns = {"oracle": [y], **{m: [y, *xs] for m, xs in models.items()}}
    multi = materialize_small(R.group_moments_multi(frame, [*keys, "condition"], columns))
    cells = {m: R.moments_of(multi, [*keys, "condition"], m, c) for m, c in columns.items()}
    cmw = R.cell_mean_wide(cells["oracle"], keys, "condition", y)
    long = R.cell_mean_long(cmw, keys, "condition", "oracle")
    loo = R.looic(R.loo_pointwise_cells(frame, cmw, keys, "condition", y), keys).withColumn("model", F.lit("oracle"))
    for m, xs in models.items():
        wide = R.ols_wide(R.combine_moments(cells[m], keys, columns[m]), keys, y, xs)
        long = long.unionByName(R.ols_long(wide, keys, xs, m))
        loo = loo.unionByName(R.looic(R.loo_pointwise(frame, wide, keys, y, xs), keys).withColumn("model", F.lit(m)))
    return {"models": long, "pooled": R.pooled_effect(cmw, keys), "looic": loo}
