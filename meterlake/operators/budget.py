"""Budgets: thresholds, ranges and who spent most."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import project_label, report_day, usd


def warnings(report: DataFrame, threshold: float) -> DataFrame:
    """Buckets whose cost reaches the threshold; a negative or non-finite one gives none."""
    ok = math.isfinite(threshold) and threshold >= 0
    out = report.filter(F.col("cost_usd") >= threshold) if ok else report.limit(0)
    return out.select("period", "cost_usd", F.lit(float(threshold)).alias("threshold"))


def ranges(spark, today: dt.date, daily: float | None, monthly: float | None, begin: dt.date | None = None, end: dt.date | None = None,
    limit: float | None = None) -> DataFrame:
    """Today, the month to date, and the selected range where both its ends are given."""
    rows = [("today", today, today, daily), ("month", today.replace(day=1), today, monthly)]
    if begin is not None and end is not None:
        rows.append(("range", begin, end, limit))
    return spark.createDataFrame(rows, "scope string, begin date, end date, threshold double")


def _in_ranges(rows: DataFrame, scopes: DataFrame, tz: str) -> DataFrame:
    """Rows with each range they fall in; there are three ranges at most, so they are broadcast."""
    day = report_day("timestamp", tz)
    return rows.withColumn("_day", day).join(F.broadcast(scopes), F.col("_day").between(F.col("begin"), F.col("end")))


def budget_report(rows: DataFrame, scopes: DataFrame, tz: str = "UTC") -> DataFrame:
    """Per range: cost, threshold, percent of it (null without one) and what remains."""
    spent = _in_ranges(rows, scopes, tz).groupBy("scope").agg(F.sum("exact").alias("exact"), F.count(F.lit(1)).alias("request_count"))
    cost = F.coalesce(usd("exact"), F.lit(0.0))
    return scopes.join(spent, "scope", "left").select(
        "scope", "begin", "end", cost.alias("cost_usd"), "threshold",
        F.when(F.col("threshold") > 0, F.round(cost / F.col("threshold") * 100, 6)).alias("percent"),
        F.round(F.col("threshold") - cost, 6).alias("remaining"),
        F.coalesce("request_count", F.lit(0)).alias("request_count"),
    )


def contributors(rows: DataFrame, scopes: DataFrame, tz: str = "UTC") -> DataFrame:
    """Per range the provider, model and project with most tokens; ranges without requests have none."""
    inside = _in_ranges(rows, scopes, tz)
    kinds = {"provider": F.col("provider"), "model": F.concat_ws("/", "provider", "model_id"), "project": project_label()}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in kinds.items())))
    sums = inside.select("scope", "total_tokens", pairs.alias("x")).groupBy("scope", "x.kind",
        "x.name").agg(F.sum("total_tokens").alias("total_tokens"))
    first = F.row_number().over(Window.partitionBy("scope", "kind").orderBy(F.desc("total_tokens"), "name"))
    return sums.withColumn("_r", first).filter("_r = 1").drop("_r")
