"""Student-t quantiles as a plain column expression.

Spark and DuckDB have no t quantile function.  Up to TABLE_DF degrees of
freedom the 97.5 % points are solved from the closed form of the distribution
for whole degrees of freedom and stand in the plan as one array; beyond, the
Cornish-Fisher expansion around the normal quantile is exact to 1e-8.  The SQL
oracles use the same numbers, which the tests hold against printed tables.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the 97.5 % quantile of the standard normal distribution.
Z975 = 1.959963984540054
TABLE_DF = 100


def t_central(t: float, nu: int) -> float:
    """P(-t < T < t) for ``nu`` whole degrees of freedom."""
    theta = math.atan(t / math.sqrt(nu))
    c2 = math.cos(theta) ** 2
    total, term = 0.0, 1.0
    odd = nu % 2
    for k in range((nu - 1) // 2 if odd else nu // 2):
        total += term
        term *= c2 * ((2 * k + 2) / (2 * k + 3) if odd else (2 * k + 1) / (2 * k + 2))
    if odd:
        return 2.0 / math.pi * (theta + math.sin(theta) * math.cos(theta) * total)
    return math.sin(theta) * total


@lru_cache(maxsize=1)
def t_table() -> tuple[float, ...]:
    """97.5 % points for 1 .. TABLE_DF degrees of freedom, by bisection."""
    found = []
    for nu in range(1, TABLE_DF + 1):
        low, high = 1.9, 13.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if t_central(mid, nu) < 0.95 else (low, mid)
        found.append((low + high) / 2)
    return tuple(found)


def _terms(z: float) -> tuple[float, float, float, float]:
    return ((z ** 3 + z) / 4.0, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0,
            (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0,
            (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0)


def t_quantile(nu) -> Column:
    """97.5 % quantile of Student t with ``nu`` degrees of freedom (null below 1)."""
    nu = F.col(nu) if isinstance(nu, str) else nu
    x = nu.cast("double")
    g = _terms(Z975)
    far = F.lit(Z975) + (F.lit(g[0]) + (F.lit(g[1]) + (F.lit(g[2]) + F.lit(g[3]) / x) / x) / x) / x
    near = F.get(F.array(*[F.lit(v) for v in t_table()]), nu.cast("int") - 1)
    return F.when(x > TABLE_DF, far).when(x >= 1, near)


def t_quantile_sql(nu_sql: str) -> str:
    """The same as SQL text, for the DuckDB oracles."""
    g = _terms(Z975)
    n = f"CAST({nu_sql} AS DOUBLE)"
    far = f"{Z975!r} + ({g[0]!r} + ({g[1]!r} + ({g[2]!r} + {g[3]!r} / {n}) / {n}) / {n}) / {n}"
    near = "list_extract([" + ", ".join(map(repr, t_table())) + f"]::DOUBLE[], CAST({nu_sql} AS INTEGER))"
    return f"(CASE WHEN {n} > {TABLE_DF} THEN {far} WHEN {n} >= 1 THEN {near} END)"


# The coefficients of algorithm AS 241 (Wichura 1988), highest power first, of the
# centre, the tails and the far tails: numerator, denominator.
NORMAL_CENTRE = (
    (2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
     1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
    (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
     5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0))
NORMAL_TAIL = (
    (7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
     3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
    (1.05075007164441684324e-9, 5.4759380849953449460e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0))
NORMAL_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0))


def _ratio(coefficients, r):
    """Numerator over denominator by Horner's rule."""
    parts = []
    for row in coefficients:
        value = F.lit(row[0])
        for c in row[1:]:
            value = value * r + F.lit(c)
        parts.append(value)
    return parts[0] / parts[1]


def normal_quantile(p):
    """Quantile of the standard normal distribution, 0 < p < 1, to about 1e-15 (column expression)."""
    q = p - F.lit(0.5)
    tail = F.sqrt(-F.log(F.when(q <= 0, p).otherwise(1 - p)))
    far = F.when(tail <= 5, _ratio(NORMAL_TAIL, tail - 1.6)).otherwise(_ratio(NORMAL_FAR, tail - 5))
    return F.when(F.abs(q) <= 0.425, q * _ratio(NORMAL_CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * far)
