"""A plan boundary for columns that are costly to work out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, keep: list[str], cols: dict[str, Column]) -> DataFrame:
    """``keep`` and ``cols`` of df, the latter worked out once per row whatever is done with them above.

    A filter on a projected column is pushed below the projection with the column's whole
    expression in place of its name, once for each mention; over several such projections the
    plan grows beyond use. A one-element explode yields plain attributes, where that stops.
    It runs inside whole-stage codegen and moves no rows.
    """
    made = df.select(*keep, F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("_settled"))
    return made.select(*keep, *[F.col(f"_settled.{k}").alias(k) for k in cols])
