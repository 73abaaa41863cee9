"""Numeric expressions with the edge rules that scores and statistics rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grades and the least total of each; anything lower is D.
GRADES = (("A", 85.0), ("B", 70.0), ("C", 55.0))


def number_or(c: Column | str, default: float = 0.0) -> Column:
    """The value as a double; text that is no number, blanks and NaN give the default."""
    x = (c if isinstance(c, Column) else F.col(c)).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def standardized(raw: Column) -> Column:
    """1..5 mapped to 0..100; null outside that range."""
    return F.when(raw.between(1, 5), F.round(100.0 * (raw - 1) / 4.0, 6))


def weighted(std: Column, weight: float | Column) -> Column:
    return F.round(std * (F.lit(float(weight)) if not isinstance(weight, Column) else weight), 6)


def grade(total: Column) -> Column:
    out = F.lit("D")
    for name, least in reversed(GRADES):
        out = F.when(total >= least, name).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def truthy(c: Column) -> Column:
    """Flags spelt 1, true, yes or y, in any case."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin("1", "true", "yes", "y")


def pearson(n: Column, mean_x: Column, mean_y: Column, cov: Column, sd_x: Column, sd_y: Column, *, least: int = 2, constant: Column | float = 0.0) -> Column:
    """Correlation from population moments: 0 under `least` pairs, `constant` where a side does not vary, within [-1, 1], to six digits."""
    flat = (sd_x < 1e-12) | (sd_y < 1e-12)
    ratio = cov / F.when(flat, F.lit(1.0)).otherwise(sd_x * sd_y)
    return F.when(n < least, F.lit(0.0)).when(flat, constant if isinstance(constant, Column) else F.lit(float(constant))).otherwise(F.round(clamp(ratio, -1.0, 1.0), 6))


def pearson_of(x: str, y: str, *, least: int = 2, constant: Column | float = 0.0) -> Column:
    """Aggregate expression: correlation of two columns over pairs without nulls.

    Population moments never divide by zero, unlike the built-in correlation on a
    column that does not vary.
    """
    a, b = F.when(F.col(y).isNotNull(), F.col(x).cast("double")), F.when(F.col(x).isNotNull(), F.col(y).cast("double"))
    return pearson(F.count(a), F.avg(a), F.avg(b), F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b), least=least, constant=constant)


def same_everywhere(x: str, y: str) -> Column:
    """Aggregate: 1.0 if both columns are equal in all rows, else 0.0."""
    return F.when(F.bool_and(F.col(x).eqNullSafe(F.col(y))), 1.0).otherwise(0.0)


def judgement(value: Column, strong: float, fair: float, names: tuple[str, str, str] = ("stable", "moderate", "unstable")) -> Column:
    return F.when(value >= strong, names[0]).when(value >= fair, names[1]).otherwise(names[2])


def difference_flag(diff: Column, *limits: tuple[float, str], low: str = "stable") -> Column:
    """Label of the largest limit that the difference exceeds."""
    out = F.lit(low)
    for limit, name in sorted(limits):
        out = F.when(diff > limit, name).otherwise(out)
    return out
