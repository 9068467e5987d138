"""Quantile maps: values to a normal distribution through a table of exact quantiles."""

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def knots(df: DataFrame, col: str, n: int = 1000, most: float | None = None) -> list[float]:
    """n exact quantiles (linear interpolation) of the values in (0, most)."""
    rows = df.where((F.col(col) > 0) & (F.lit(True) if most is None else F.col(col) < most))
    found = rows.agg(F.percentile(col, [i / (n - 1) for i in range(n)])).first()[0]
    return [float(x) for x in found or []]


def to_normal(value: Column, table: list[float], clip: float = 1e-7) -> Column:
    """Piecewise-linear map of a value to the normal quantile of its rank; ends are clipped."""
    n = len(table)
    normal = [NormalDist().inv_cdf(min(1 - clip, max(clip, i / (n - 1)))) for i in range(n)]
    xs, ys = F.array(*[F.lit(x) for x in table]), F.array(*[F.lit(y) for y in normal])
    at = F.least(F.greatest(F.size(F.filter(xs, lambda x: x <= value)) - 1, F.lit(0)), F.lit(n - 2))
    x0, x1, y0, y1 = F.get(xs, at), F.get(xs, at + 1), F.get(ys, at), F.get(ys, at + 1)
    t = F.coalesce(F.try_divide(value - x0, x1 - x0), F.lit(0.0))
    return y0 + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (y1 - y0)


def lower_median(col: str) -> Column:
    return F.expr(f"percentile_disc(0.5) within group (order by {col})")
