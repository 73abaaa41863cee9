"""Gates, monitors, exclusions and case lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cases(df: DataFrame, keys: list[str], rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """keys, source, metric, value: a row for each rule (source, metric, condition, value) that holds."""
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(source).alias("source"), F.lit(metric).alias("metric"), value.alias("value"))) for source, metric, when, value in rules]))
    return df.select(*keys, F.explode(found).alias("c_")).select(*keys, "c_.*")


def quality_gates(measures: DataFrame, gates: list[tuple[str, str, float]]) -> DataFrame:
    """metric, value, threshold, passed for one row of measures; a gate (column, 'min' or 'max', threshold). A missing measure fails."""
    rows = [F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.coalesce(F.col(name) >= t if kind == "min" else F.col(name) <= t, F.lit(False)).alias("passed")) for name, kind, t in gates]
    return measures.select(F.inline(F.array(*rows)))


def all_passed(gates: DataFrame, names: list[str]) -> DataFrame:
    """One row: passed, blockers (sorted names of failed or missing gates)."""
    failed = gates.where(F.col("metric").isin(*names)).agg(F.collect_set(F.when(F.col("passed"), F.col("metric"))).alias("ok"))
    blockers = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in names]), "ok"))
    return failed.select((F.size(blockers) == 0).alias("passed"), blockers.alias("blockers"))


def exclusions(df: DataFrame, id_col: str, checks: dict[str, Column]) -> DataFrame:
    """id, excluded, reasons (sorted): a document is excluded where any of its rows fails a check."""
    agg = df.groupBy(id_col).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in checks])))
    return agg.select(id_col, (F.size(reasons) > 0).alias("excluded"), F.array_join(reasons, ";").alias("reasons"))


def reason_distribution(df: DataFrame, reasons_col: str, domain: list[str]) -> DataFrame:
    """reason, n for every reason of the domain, zero where none has it."""
    has = [F.count_if(F.array_contains(F.split(reasons_col, ";"), r)).alias(r) for r in domain]
    return df.agg(*has).unpivot([], [F.col(r) for r in domain], "reason", "n")


def rates(df: DataFrame, conditions: dict[str, Column], *, empty: float = 0.0) -> DataFrame:
    """One row with the share of rows for which each condition holds; `empty` without rows."""
    return df.agg(*[F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(empty)), 6).alias(n) for n, c in conditions.items()])
