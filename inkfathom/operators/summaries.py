"""Quantiles from counts by bucket, which batches add to.

A positive value x falls in bucket ceil(log(x) / log(g)), g = (1 + a) / (1 - a); its bucket's
middle is off by at most the share a of it (Masson, Rim and Lee, DDSketch, 2019). Negative
values have buckets of their own, zero has one. Counts of the same buckets add up, so a
summary of all that came is the sum of the batches' summaries: a table of as many rows a
group as there are orders of magnitude, whatever the number of values.

Defined cases: null values and those that are not numbers are left out; infinities are
the first and the last bucket; a group without values has no quantile; an empty table gives
no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.sources.store import KeyedTable

ERROR = 0.01
#: Buckets of zero and of the infinities; others lie in between.
_EDGE = 1 << 20


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    v = value.cast("double")
    k = F.ceil(F.log(F.abs(v)) / math.log(_gamma(error))) + _EDGE
    return F.when(v == 0, 0).when(F.abs(v) == float("inf"), F.signum(v) * 2 * _EDGE).otherwise(F.signum(v) * k).cast("int")


def middle(b: Column, error: float = ERROR) -> Column:
    g = _gamma(error)
    size = F.pow(F.lit(g), F.abs(b) - _EDGE) * 2 / (1 + g)
    return F.when(b == 0, 0.0).when(F.abs(b) == 2 * _EDGE, F.signum(b) * float("inf")).otherwise(F.signum(b) * size)


def summary(values: DataFrame, group: str, value: str, error: float = ERROR) -> DataFrame:
    """grp, slot (its bucket), n and total: counts and sums of a batch's values."""
    fine = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cell = fine.select(F.col(group).cast("string").alias("grp"), bucket(F.col(value), error).alias("slot"), F.col(value).cast("double").alias("v"))
    return cell.groupBy("grp", "slot").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def added(table: KeyedTable, batch: DataFrame, source: str = "", number: int | None = None) -> int:
    """Adds a batch's summary to the table made by ``summary_table``; a batch that was added before is left out."""
    key = F.concat_ws("\x1f", "slot", F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")))
    new = batch.withColumn("cell", key)
    old = table.read().select("cell", F.col("n").alias("__n"), F.col("total").alias("__total"))
    both = new.join(old, "cell", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = both.select("cell", "grp", "slot", (F.col("n") + zero("__n")).alias("n"), (F.col("total") + F.coalesce("__total", F.lit(0.0))).alias("total"))
    return table.merge(rows, source=source, number=number)


def summary_table(spark, path: str) -> KeyedTable:
    return KeyedTable.create(spark, path, "cell string, grp string, slot int, n bigint, total double", "cell", 16)


def quantiles(summaries: DataFrame, shares: list[float], error: float = ERROR) -> DataFrame:
    """grp, count, mean and a column p<share in per cent> for each share: the value at the place share * (count - 1), from below."""
    cells = summaries.groupBy("grp", "slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    w = Window.partitionBy("grp").orderBy("slot")
    upto = cells.withColumn("upto", F.sum("n").over(w))
    totals = cells.groupBy("grp").agg(F.sum("n").alias("count"), (F.sum("total") / F.sum("n")).alias("mean"))
    placed = upto.join(totals.withColumnRenamed("grp", "__g"), F.col("grp").eqNullSafe(F.col("__g")))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("count") - 1)), F.col("slot")))
    found = placed.groupBy("grp").agg(F.first("count").alias("count"), F.first("mean").alias("mean"), *(at(p).alias(f"p{p * 100:g}") for p in shares))
    return found.select("grp", "count", "mean", *(middle(F.col(f"`p{p * 100:g}`"), error).alias(f"p{p * 100:g}") for p in shares))
