"""Declarative data-quality checks; every check is ``(family, label, violations)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    family: str
    label: str
    violated: Column


def row_checks(rows: DataFrame, checks: list[Check]) -> DataFrame:
    """All checks of a table in one pass: one aggregate, then one row per check."""
    sums = rows.agg(*[F.coalesce(F.sum(F.coalesce(c.violated, F.lit(False)).cast("long")), F.lit(0)).alias(f"c{i}") for i, c in enumerate(checks)])
    cells = [F.struct(F.lit(c.family).alias("family"), F.lit(c.label).alias("label"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(checks)]
    return sums.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def not_null(table: str, *columns: str) -> list[Check]:
    return [Check("not_null", f"{table}.{c}", F.col(c).isNull()) for c in columns]


def member(table: str, column: str, legal: list[str]) -> Check:
    return Check("enum", f"{table}.{column}", F.col(column).isNotNull() & ~F.col(column).isin(*legal))


def orphans(label: str, child: DataFrame, key: Column, parent: DataFrame, parent_key: str = "id", family: str = "orphan") -> DataFrame:
    """Rows whose key has no row in the parent table; null keys are no violation."""
    keys = child.select(key.alias("_k")).where("_k is not null")
    lost = keys.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(family).alias("family"), F.lit(label).alias("label"), "violations")


def repeated(label: str, rows: DataFrame, *columns: str) -> DataFrame:
    """Number of key values that occur more than once."""
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("quality").alias("family"), F.lit(label).alias("label"), "violations")


def gaps(label: str, rows: DataFrame, key: str, number: str) -> DataFrame:
    """Number of places where a number of a key's sequence is missing."""
    w = Window.partitionBy(key).orderBy(number)
    steps = rows.select(key, number).distinct().withColumn("_n", F.lead(number).over(w)).where(F.col("_n") > F.col(number) + 1)
    return steps.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("quality").alias("family"), F.lit(label).alias("label"), "violations")


def report(*parts: DataFrame) -> DataFrame:
    """All results with ``passed``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("violations") == 0)
