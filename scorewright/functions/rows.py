"""How often the expressions of a row are worked out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row.

    A filter moves below a plain projection and takes the expressions it names along, so
    that each is worked out once more for every mention of it; it does not move below this.
    """
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("once_", row).select(*df.columns, *[F.col(f"once_.{n}").alias(n) for n in columns])
