"""Closed forms that Spark lacks, as SQL text that any engine evaluates alike.

Fixed values: the rational approximation of the normal distribution function by Hart (1968) and West (2005), with an
absolute error near 1e-16.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def lit(x: float) -> str:
    """A double literal that no engine reads as a decimal."""
    return f"{x!r}" if "e" in repr(float(x)) else f"{float(x)!r}e0"


def _horner(coefficients: tuple[float, ...], z: str) -> str:
    out = lit(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {z} + {lit(c)})"
    return out


def normal_cdf_sql(x: str) -> str:
    """P(Z <= x)."""
    z, t = f"abs({x})", f"exp(-({x}) * ({x}) / 2e0)"
    tail = f"{t} / ({z} + 1e0 / ({z} + 2e0 / ({z} + 3e0 / ({z} + 4e0 / ({z} + 0.65e0))))) / 2.506628274631e0"
    q = f"CASE WHEN {z} > 37e0 THEN 0e0 WHEN {z} < 7.07106781186547e0 THEN {t} * {_horner(_NUM, z)} / {_horner(_DEN, z)} ELSE {tail} END"
    return f"(CASE WHEN ({x}) > 0e0 THEN 1e0 - ({q}) ELSE ({q}) END)"


def erf_sql(x: str) -> str:
    return f"(2e0 * {normal_cdf_sql(f'(({x}) * 1.4142135623730951e0)')} - 1e0)"


def softplus_sql(x: str, s: float = 0.02) -> str:
    """A smooth max(0, x) of width s; far above zero it is x itself."""
    z = f"(({x}) / {lit(s)})"
    return f"(CASE WHEN {z} > 40e0 THEN ({x}) ELSE {lit(s)} * ln(1e0 + exp(least({z}, 40e0))) END)"


def sigmoid_sql(x: str, s: float = 0.02) -> str:
    """A smooth step of width s, which is flat beyond 40 widths."""
    z = f"(({x}) / {lit(s)})"
    return f"(CASE WHEN {z} > 40e0 THEN 1e0 WHEN {z} < -40e0 THEN 0e0 ELSE 1e0 / (1e0 + exp(-greatest(least({z}, 40e0), -40e0))) END)"


def chi2_sf_3_sql(x: str) -> str:
    """P(a chi-square variable with three degrees of freedom exceeds x)."""
    return f"(CASE WHEN ({x}) <= 0e0 THEN 1e0 ELSE 2e0 * (1e0 - {normal_cdf_sql(f'sqrt({x})')}) + sqrt(2e0 * ({x}) / 3.141592653589793e0) * exp(-({x}) / 2e0) END)"


def probability_above_sql(mean: str, sd: str, least: str) -> str:
    """P(X >= least); a spread of at most 1e-15 makes it certain."""
    return f"(CASE WHEN {sd} <= 1e-15 THEN CASE WHEN {mean} >= {least} THEN 1e0 ELSE 0e0 END ELSE {normal_cdf_sql(f'(({mean} - {least}) / nullif({sd}, 0e0))')} END)"


def normal_cdf(x: Column, spark_name: str = "_x") -> Column:
    """P(Z <= x) as a Column."""
    z, t = F.abs(x), F.exp(-x * x / 2)

    def horner(cs: tuple[float, ...]) -> Column:
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * z + c
        return out

    tail = t / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    q = F.when(z > 37, 0.0).when(z < 7.07106781186547, t * horner(_NUM) / horner(_DEN)).otherwise(tail)
    return F.when(x > 0, 1 - q).otherwise(q)


def portable(x: Column) -> Column:
    """A double at 12 significant digits: the same text on every machine."""
    return F.format_string("%.11e", x + F.lit(0.0))


def det3(m: str) -> str:
    """Determinant of a row-major 3 x 3 array column."""
    a = [f"{m}[{i}]" for i in range(9)]
    return f"({a[0]} * ({a[4]} * {a[8]} - {a[5]} * {a[7]}) - {a[1]} * ({a[3]} * {a[8]} - {a[5]} * {a[6]}) + {a[2]} * ({a[3]} * {a[7]} - {a[4]} * {a[6]}))"


def inv3(m: str) -> str:
    """Inverse of a row-major 3 x 3 array column by cofactors; a zero determinant gives null."""
    a = [f"{m}[{i}]" for i in range(9)]
    cof = lambda p, q, r, s: f"({a[p]} * {a[q]} - {a[r]} * {a[s]})"
    rows = [cof(4, 8, 5, 7), cof(2, 7, 1, 8), cof(1, 5, 2, 4), cof(5, 6, 3, 8), cof(0, 8, 2, 6), cof(2, 3, 0, 5), cof(3, 7, 4, 6), cof(1, 6, 0, 7), cof(0, 4, 1, 3)]
    return "array(" + ", ".join(f"{c} / nullif({det3(m)}, 0e0)" for c in rows) + ")"
