"""Sinks: CSV, JSON, appended logs, replaced partitions, merged tables, and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in this order as strings; missing ones and nulls are empty, others are left out."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    projected(df, columns).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Overwrites only the partitions that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def without_keys(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `current` whose key `new` has not, and all rows of `new`."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def markdown(df: DataFrame, most: int = 50) -> str:
    """A table of the first rows of a small result."""
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def histogram(df: DataFrame, value: str, *, most_bins: int = 20) -> DataFrame:
    """bin, low, high, n of a column over min(most_bins, max(3, n)) equal bins, ready to draw."""
    x = F.col(value).cast("double")
    m = df.agg(F.count(x).alias("n_"), F.min(x).alias("lo_"), F.max(x).alias("hi_")).withColumn("k_", F.least(F.lit(most_bins), F.greatest(F.lit(3), "n_")).cast("int"))
    step = (F.col("hi_") - F.col("lo_")) / F.col("k_")
    at = F.when(step == 0, 0).otherwise(F.least(F.col("k_") - 1, F.floor((x - F.col("lo_")) / F.when(step == 0, 1.0).otherwise(step)))).cast("int")
    return df.where(x.isNotNull()).join(F.broadcast(m), F.lit(True)).groupBy(at.alias("bin"), (F.col("lo_") + at * step).alias("low"), (F.col("lo_") + (at + 1) * step).alias("high")).agg(F.count("*").alias("n"))


def empty_outputs(spark: SparkSession, paths: dict[str, bool]) -> DataFrame:
    """path, rows, status of Parquet outputs: problem where an output has no rows and may not be empty."""
    rows = []
    for path, may_be_empty in paths.items():
        n = spark.read.parquet(path).count()
        rows.append((path, n, "ok" if n else "allowed_empty" if may_be_empty else "problem_empty"))
    return spark.createDataFrame(rows, "path string, rows long, status string")
