"""Association and significance measures as Column expressions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a published Chebyshev fit of erfc, from the constant on; relative error under 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _part(o: Column, e: Column) -> Column:
    return F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(F.lit(0.0))


def g2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood of a two-by-two table."""
    n = a + b + c + d
    cells = ((a, (a + b) * (a + c) / n), (b, (a + b) * (b + d) / n), (c, (c + d) * (a + c) / n), (d, (c + d) * (b + d) / n))
    return F.when(n > 0, 2 * sum((_part(o, e) for o, e in cells), F.lit(0.0))).otherwise(F.lit(0.0))


def keyness_ll(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood of a against b occurrences in c and d tokens."""
    share = (a + b) / (c + d)
    return 2 * (_part(a, c * share) + _part(b, d * share))


def chi2_p(x: Column) -> Column:
    """The upper tail of chi-square with one degree of freedom: erfc(sqrt(x / 2))."""
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    t = 1 / (1 + z / 2)
    poly = F.lit(ERFC[-1])
    for k in ERFC[-2::-1]:
        poly = F.lit(k) + t * poly
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), t * F.exp(poly - z * z)))


def per_10k(freq: Column, total: Column) -> Column:
    return F.when(total > 0, freq * 10_000.0 / total).otherwise(F.lit(0.0))


def ratio(x: Column, y: Column) -> Column:
    return F.when(x + y > 0, x / (x + y)).otherwise(F.lit(0.0))


def part_sql(o: str, e: str) -> str:
    return f"CASE WHEN {o} > 0 AND {e} > 0 THEN {o} * ln({o} / ({e})) ELSE 0 END"


def g2_sql(a: str, b: str, c: str, d: str) -> str:
    n = f"({a} + {b} + {c} + {d})"
    cells = ((a, f"({a} + {b}) * ({a} + {c}) / {n}"), (b, f"({a} + {b}) * ({b} + {d}) / {n}"), (c, f"({c} + {d}) * ({a} + {c}) / {n}"), (d, f"({c} + {d}) * ({b} + {d}) / {n}"))
    return f"CASE WHEN {n} > 0 THEN 2 * ({' + '.join(part_sql(o, e) for o, e in cells)}) ELSE 0 END"


def chi2_p_sql(x: str) -> str:
    z = f"sqrt(greatest({x}, 0) / 2)"
    poly = str(ERFC[-1])
    for k in ERFC[-2::-1]:
        poly = f"({k} + t * {poly})"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE least(1.0, (SELECT t * exp({poly} - {z} * {z}) FROM (SELECT 1 / (1 + {z} / 2) AS t))) END"
