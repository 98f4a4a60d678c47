"""End to end on own fixtures: survey CSV + control table -> enriched rows -> analysis -> models."""

import os
import tempfile

import numpy as np

from textcontrols.plans.study import analysis_rows, enrich_survey, fit_suite

TEXTS = ["Bright citrus notes in a light body", "Dark cocoa and a heavy round body",
         "Bright citrus notes in a light body, grown by a certified cooperative",
         "Dark cocoa and a heavy round body, grown by a certified cooperative"]
CONTROLS = [(0, TEXTS[0], 0.5, -1.0), (1, TEXTS[1], 1.5, 0.0), (2, TEXTS[2], 2.0, 1.0), (3, TEXTS[3], 3.5, 2.5)]
LEVELS = ["BaseX", "ShortX", "LongX"]


def _survey(path, rng):
    lines = ['StartDate,Q_TerminateFlag,DVPref_Rating_1,BaseOnLeft,ComparisonCondition,Text_Base,Text_Comparison']
    lines.append('Start Date,"Terminate ""flag""\nline two",Rating,Left,Condition,Base,Comparison')
    lines.append('"{""ImportId"":""startDate""}",x,x,x,x,x,x')
    rows = []
    for i in range(60):
        cond = LEVELS[i % 3]
        base, comp = (TEXTS[0], TEXTS[2]) if i % 2 else (TEXTS[1], TEXTS[3])
        if cond == "BaseX":
            comp = base
        flag = "Screened" if i % 17 == 0 else "Complete"
        rating = str(int(rng.integers(1, 8)))
        left = str(i % 2)
        comp_text = comp.upper() + "™" if i % 5 == 0 else comp  # normalisation makes it match
        if i % 23 == 0:
            comp_text = "an unknown text"
        rows.append((i, flag, rating, left, cond, base, comp_text))
        lines.append(f'2025-01-01 10:{i:02d}:00,{flag},{rating},{left},{cond},"{base}","{comp_text}"')
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return rows


def test_study_end_to_end(spark):
    rng = np.random.default_rng(11)
    path = os.path.join(tempfile.mkdtemp(prefix="tc-study-"), "survey.csv")
    rows = _survey(path, rng)
    controls = spark.createDataFrame(CONTROLS, "position long, description string, INTN1 double, INTN2 double")
    enriched = enrich_survey(spark, path, controls, experiment="X")
    assert enriched.count() == 60
    d = analysis_rows(enriched, LEVELS)
    pdf = d.toPandas()
    # expected filter: complete, matched both sides (unknown comparison text unmatched)
    keep = [r for r in rows if r[1] == "Complete" and r[6] != "an unknown text"]
    assert len(pdf) == len(keep)
    out = fit_suite(d, ["experiment"])
    models = {(r.model, r.parameter): r for r in out["models"].collect()}
    y = pdf["Pref"].to_numpy(float)
    X = np.column_stack([np.ones(len(y)), pdf["wc_diff"].to_numpy(float)])
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert abs(models[("wc", "Intercept")].estimate - b[0]) < 1e-9
    assert abs(models[("oracle", "ShortX")].estimate - y[pdf["condition"] == "ShortX"].mean()) < 1e-12
    assert {r.model for r in out["looic"].collect()} == {"oracle", "wc", "controls_1", "controls_2"}
    # control differences: comparison minus base from the control table
    r0 = pdf.iloc[0]
    base_v = {t: (a, b2) for _, t, a, b2 in CONTROLS}
    exp = np.subtract(base_v[TEXTS[2] if r0["Text_Base"] == TEXTS[0] else TEXTS[3]], base_v[r0["Text_Base"]]) \
        if r0["ComparisonCondition"] != "BaseX" else np.zeros(2)
    assert np.allclose([r0["INTN1"], r0["INTN2"]], exp)
