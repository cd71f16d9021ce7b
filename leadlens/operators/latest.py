"""The newest row of a key, in the orders that differ about missing times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (which should end in a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest(df: DataFrame, mode: str = "view", keys: tuple[str, ...] = ("email_id",)) -> DataFrame:
    """view: verified or else checked time, a row without either wins; api: verified time, missing last; max_id: the largest id."""
    at = F.coalesce("verified_at", "checked_at") if mode == "view" else F.col("verified_at")
    orders = {"view": F.struct(at.isNull(), at, F.col("id")), "api": F.struct(at, F.col("id")), "max_id": F.col("id")}  # a null comes before all others
    if mode not in orders:
        raise ValueError(f"unknown mode {mode!r}")
    # an aggregate, so rows are compared before they are shuffled
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), orders[mode]).alias("s")).select(*keys, "s.*").select(*df.columns)
