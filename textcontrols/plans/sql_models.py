"""SQL text generators for the model oracles (DuckDB), mirroring operators.regress."""

from __future__ import annotations

from textcontrols.functions.stats import t_quantile_sql


def _r(x: str, d: int) -> str:
    return f"round({x}, {d})"


def _interval(est: str, var: str, nu: str, d: int) -> str:
    tq = t_quantile_sql(nu)
    return (f"{_r(est, d)} AS estimate, "
            f"{_r(f'CASE WHEN {nu} > 2 THEN sqrt(({var}) * {nu} / ({nu} - 2)) END', d)} AS est_error, "
            f"{_r(f'{est} - {tq} * sqrt({var})', d)} AS q_lo, {_r(f'{est} + {tq} * sqrt({var})', d)} AS q_hi")


def ols_wide_sql(frame: str, keys: list[str], y: str, xs: list[str]) -> str:
    """One row per group: n, nu, s2, b0.., v_i_j, m_x (same names as ols_wide)."""
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    gb = f"GROUP BY {k}" if keys else ""
    mom = [f"count(*) AS n", f"avg({y}) AS my", f"var_pop({y}) * count(*) AS syy"]
    for i, x in enumerate(xs, 1):
        mom += [f"avg({x}) AS m{i}", f"covar_pop({x}, {y}) * count(*) AS s{i}y"]
        for j, x2 in enumerate(xs, 1):
            if j >= i:
                mom.append(f"covar_pop({x}, {x2}) * count(*) AS s{i}{j}")
    g = f"SELECT {kk}{', '.join(mom)} FROM {frame} {gb}"
    if len(xs) == 1:
        f = ("SELECT *, s1y / s11 AS b1, my - s1y / s11 * m1 AS b0, syy - s1y / s11 * s1y AS rss, n - 2 AS nu,"
             " 1.0 / s11 AS v_1_1, -m1 / s11 AS v_0_1, 1.0 / n + m1 * m1 / s11 AS v_0_0 FROM g")
    elif len(xs) == 2:
        f = ("SELECT *, my - b1 * m1 - b2 * m2 AS b0, syy - b1 * s1y - b2 * s2y AS rss, n - 3 AS nu,"
             " i11 AS v_1_1, i22 AS v_2_2, i12 AS v_1_2, -(i11 * m1 + i12 * m2) AS v_0_1,"
             " -(i12 * m1 + i22 * m2) AS v_0_2,"
             " 1.0 / n + m1 * m1 * i11 + 2 * m1 * m2 * i12 + m2 * m2 * i22 AS v_0_0"
             " FROM (SELECT *, i11 * s1y + i12 * s2y AS b1, i12 * s1y + i22 * s2y AS b2"
             "       FROM (SELECT *, s22 / (s11 * s22 - s12 * s12) AS i11, s11 / (s11 * s22 - s12 * s12) AS i22,"
             "             -s12 / (s11 * s22 - s12 * s12) AS i12 FROM g))")
    else:
        raise ValueError("up to two regressors")
    return f"(WITH g AS ({g}), f AS ({f}) SELECT *, CASE WHEN nu > 0 THEN rss / nu END AS s2 FROM f)"


def ols_long_sql(frame: str, keys: list[str], y: str, xs: list[str], model: str, d: int = 4) -> str:
    w = ols_wide_sql(frame, keys, y, xs)
    kk = "".join(f"{k}, " for k in keys)
    parts = []
    for j, name in enumerate(["Intercept", *xs]):
        parts.append(f"SELECT {kk}'{model}' AS model, '{name}' AS parameter, n, nu, "
                     f"{_interval(f'b{j}', f's2 * v_{j}_{j}', 'nu', d)} FROM {w}")
    return "(" + " UNION ALL ".join(parts) + ")"


def cell_wide_sql(frame: str, keys: list[str], cell: str, y: str) -> str:
    """Per cell: n, mean, n_total, nu, s2 (pooled over the cells of the group)."""
    kk = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return (f"(SELECT {kk}{cell}, n, mean, CAST(sum(n) OVER ({part}) AS BIGINT) AS n_total,"
            f" CAST(sum(n) OVER ({part}) - count(*) OVER ({part}) AS BIGINT) AS nu,"
            f" sum(ss) OVER ({part}) / (sum(n) OVER ({part}) - count(*) OVER ({part})) AS s2"
            f" FROM (SELECT {kk}{cell}, count(*) AS n, avg({y}) AS mean, var_pop({y}) * count(*) AS ss"
            f"       FROM {frame} WHERE {cell} IS NOT NULL GROUP BY {kk}{cell}))")


def interval_cols(est: str, var: str, nu: str, d: int) -> str:
    return _interval(est, var, nu, d)


def ols3_long_sql(frame: str, keys: list[str], y: str, xs: list[str], model: str, d: int = 4) -> str:
    """``y ~ 1 + x1 + x2 + x3`` per group, 3 x 3 inverse by cofactors (mirrors ols_general)."""
    assert len(xs) == 3
    k = ", ".join(keys)
    kk = "".join(f"{c}, " for c in keys)
    x1, x2, x3 = xs
    g = (f"SELECT {kk}count(*) AS n, avg({y}) AS my, var_pop({y}) * count(*) AS syy, "
         + ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(xs, 1)) + ", "
         + ", ".join(f"covar_pop({x}, {y}) * count(*) AS s{i}y" for i, x in enumerate(xs, 1)) + ", "
         + ", ".join(f"covar_pop({a}, {b}) * count(*) AS s{i}{j}" for i, a in enumerate(xs, 1)
                     for j, b in enumerate(xs, 1) if j >= i)
         + f" FROM {frame} GROUP BY {k}")
    det = "(s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22))"
    inv = (f"SELECT *, (s22 * s33 - s23 * s23) / {det} AS i11, (s13 * s23 - s12 * s33) / {det} AS i12,"
           f" (s12 * s23 - s13 * s22) / {det} AS i13, (s11 * s33 - s13 * s13) / {det} AS i22,"
           f" (s12 * s13 - s11 * s23) / {det} AS i23, (s11 * s22 - s12 * s12) / {det} AS i33 FROM g")
    b = ("SELECT *, i11 * s1y + i12 * s2y + i13 * s3y AS b1, i12 * s1y + i22 * s2y + i23 * s3y AS b2,"
         " i13 * s1y + i23 * s2y + i33 * s3y AS b3 FROM iv")
    f = ("SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, syy - b1 * s1y - b2 * s2y - b3 * s3y AS rss,"
         " n - 4 AS nu,"
         " 1.0 / n + m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33 + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23)"
         " AS v00 FROM bb")
    w = (f"(WITH g AS ({g}), iv AS ({inv}), bb AS ({b}), f AS ({f}) "
         f"SELECT *, CASE WHEN nu > 0 THEN rss / nu END AS s2 FROM f)")
    parts = []
    for j, (name, var) in enumerate([("Intercept", "v00"), (x1, "i11"), (x2, "i22"), (x3, "i33")]):
        parts.append(f"SELECT {kk}'{model}' AS model, '{name}' AS parameter, n, CAST(nu AS BIGINT) AS nu, "
                     f"{_interval(f'b{j}', f's2 * {var}', 'nu', d)} FROM {w}")
    return "(" + " UNION ALL ".join(parts) + ")"
