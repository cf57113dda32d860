"""Reports over usage and costs: rollups, gap filling, groups, summaries, series and inventories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bucket, clamp, group_label, local, log_intensity, project_label, report_day, usd
from ..schemas import PRICE_KEY, TOKEN_COLUMNS, USAGE_KEY
from ..sources.scratch import fresh_dir

SUMS = [*TOKEN_COLUMNS, "total_tokens"]
#: Calendar step of each period that has gaps filled.
STEPS = {"5min": "INTERVAL 5 MINUTES", "hourly": "INTERVAL 1 HOUR", "daily": "INTERVAL 1 DAY", "monthly": "INTERVAL 1 MONTH"}


def with_costs(usage: DataFrame, costs: DataFrame | None) -> DataFrame:
    """Usage with its exact cost; without ``costs`` the join is left out and cost is 0."""
    if costs is None:  # a report without money
        return usage.withColumn("exact", F.lit(0).cast("decimal(38,6)"))
    return usage.join(costs.select(*USAGE_KEY, "exact"), USAGE_KEY, "left")


def measures(approximate_sessions: bool = False) -> list[Column]:
    """Token sums (never below 0), cost, requests, sessions distinct per provider, first and last instant."""
    sessions = F.approx_count_distinct(F.struct("provider", "session_id")) if approximate_sessions else F.count_distinct("provider", "session_id")
    return [
        *(clamp(F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in SUMS), F.coalesce(usd(F.sum("exact")), F.lit(0.0)).alias("cost_usd"),
        F.count(F.lit(1)).alias("request_count"), sessions.alias("session_count"), F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"),
    ]


def rollup(rows: DataFrame, period: str, tz: str = "UTC", fill: bool = True, last: int | None = None) -> DataFrame:
    """One row per bucket with usage, gaps between the first and the last filled with zeros, the latest ``last`` kept."""
    out = rows.groupBy(bucket("timestamp", period, tz).alias("period")).agg(*measures())
    if fill:
        out = fill_gaps(out, period, tz)
    out = out.drop("first_at", "last_at")
    return out.orderBy("period") if last is None else tail(out, last)


def spine(report: DataFrame, period: str, tz: str = "UTC") -> DataFrame:
    """Every label from the first to the last bucket of a report.

    Days and months step on the calendar.  Shorter periods step over UTC instants, each labelled in the zone, so
    no hour is made up in spring and the doubled one is a single label in autumn; steps of at most 15 minutes
    reach every label in zones that are a fraction of an hour off.
    """
    edge = report.agg(F.min("first_at").cast("timestamp").alias("a"), F.max("last_at").cast("timestamp").alias("b")).filter("a is not null")
    if period in ("daily", "monthly"):
        unit = "DAY" if period == "daily" else "MONTH"
        ends = edge.select(*(F.trunc(local(c, tz), "MM").alias(c) if unit == "MONTH" else F.to_date(local(c, tz)).alias(c) for c in ("a", "b")))
        steps = ends.select(F.explode(F.sequence("a", "b", F.expr(STEPS[period]))).alias("at"))
        return steps.select(F.date_format("at", "yyyy-MM-dd" if unit == "DAY" else "yyyy-MM").alias("period"))
    step = 5 if period == "5min" else 15
    floor = F.timestamp_seconds(F.floor(F.unix_timestamp("a") / (step * 60)) * (step * 60))
    steps = edge.select(F.explode(F.sequence(floor, F.col("b"), F.expr(f"INTERVAL {step} MINUTES"))).alias("at"))
    return steps.select(bucket("at", period, tz).alias("period")).distinct()


def fill_gaps(report: DataFrame, period: str, tz: str = "UTC") -> DataFrame:
    """A report with a row of zeros for every missing label; yearly reports stay as they are."""
    if period not in STEPS:
        return report
    labels = spine(report, period, tz).unionByName(report.select("period")).distinct()
    return labels.join(report, "period", "left").fillna(0)


def top_days(rows: DataFrame, n: int, tz: str = "UTC") -> DataFrame:
    """The days with most tokens; equal days in calendar order."""
    return rows.groupBy(report_day("timestamp", tz).alias("day")).agg(*measures()).drop("first_at", "last_at").orderBy(F.desc("total_tokens"),
        "day").limit(n)


def by_group(rows: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """By model, provider or project: most tokens first."""
    keys = {"model": ["provider", "model_id"], "provider": ["provider"], "project": ["project"]}[by]
    src = rows.withColumn("project", project_label()) if by == "project" else rows
    out = src.groupBy(*keys).agg(*measures()).drop("first_at", "last_at").withColumn("label", group_label(by)).orderBy(F.desc("total_tokens"), *keys)
    return out if n is None else out.limit(n)


def distinct_sessions(rows: DataFrame) -> DataFrame:
    """How many sessions there are; an id counts once per provider."""
    return rows.agg(F.count_distinct("provider", "session_id").alias("sessions"))


#: Relative standard error of session sketches, that of 2^14 registers.
SKETCH_BITS, SKETCH_ERROR = 14, 1.04 / 2**7


def session_sketches(rows: DataFrame, period: str = "daily", tz: str = "UTC") -> DataFrame:
    """(period, sessions): a sketch of each bucket's sessions, a few kilobytes however many there are; made to be stored."""
    session = F.concat_ws("\0", "provider", "session_id")
    return rows.groupBy(bucket("timestamp", period, tz).alias("period")).agg(F.hll_sketch_agg(session, SKETCH_BITS).alias("sessions"))


def sketched_sessions(sketches: DataFrame, period: Column) -> DataFrame:
    """(period, estimate): sketches of shorter buckets united into longer ones, without the rows that they sum up."""
    united = F.hll_union_agg("sessions").alias("sessions")
    return sketches.groupBy(period.alias("period")).agg(united).select("period", F.hll_sketch_estimate("sessions").alias("estimate"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*measures()).drop("first_at", "last_at")


def daily_totals(rows: DataFrame, tz: str = "UTC") -> DataFrame:
    return rows.groupBy(report_day("timestamp", tz).alias("day")).agg(*measures()).select("day", "total_tokens", "input_tokens", "output_tokens",
        "cost_usd").orderBy("day")


def totals_row(report: DataFrame) -> DataFrame:
    """Column sums of the rows shown; sessions are summed, so one in two buckets counts twice."""
    return report.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), F.coalesce(F.sum("request_count"), F.lit(0)).alias("request_count"),
        F.coalesce(F.sum("session_count"), F.lit(0)).alias("session_count"))


def with_totals(report: DataFrame, label: str = "total") -> DataFrame:
    return report.unionByName(totals_row(report).withColumn("period", F.lit(label)), allowMissingColumns=True)


def provider_filled(report: DataFrame, provider: str | None = None) -> DataFrame:
    label = F.lit(provider or "all providers")
    return report.withColumn("provider", F.coalesce("provider", label) if "provider" in report.columns else label)


def series_stats(report: DataFrame, metric: str) -> DataFrame:
    c = {"tokens": "total_tokens", "cost": "cost_usd", "input": "input_tokens", "output": "output_tokens"}[metric]
    return report.agg(F.round(F.avg(c), 6).alias("average"), F.max(c).alias("largest"), F.round(F.sum(c), 6).alias("total"))


def calendar_grid(daily: DataFrame, today: dt.date, value: str = "total_tokens") -> DataFrame:
    """A day grid from this month's first day a year ago to this month's end: Sunday-based weekday row, week column."""
    first = today.replace(year=today.year - 1, day=1)
    last = (today.replace(day=1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
    # weeks begin on Sunday; the first one may begin before the first day
    sunday = first - dt.timedelta(days=(first.weekday() + 1) % 7)
    days = daily.sparkSession.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    cells = days.join(daily.select("day", F.col(value).alias("value")), "day", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    largest = cells.agg(F.max("value").alias("largest"))
    return cells.join(F.broadcast(largest)).select(
        "day", (F.dayofweek("day") - 1).alias("weekday"), F.floor(F.datediff("day", F.lit(sunday)) / 7).cast("int").alias("week"), "value",
        F.round(log_intensity("value", "largest"), 9).alias("intensity"),
    )


def inventory(usage: DataFrame, prices: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Counts per table as (item, key, n)."""
    def one(item: str, n: Column, df: DataFrame) -> DataFrame:
        return df.agg(n.cast("string").alias("value")).select(F.lit(item).alias("item"), F.lit("").alias("key"), "value")

    parts = [
        one("usage_rows", F.count(F.lit(1)), usage), one("models", F.count_distinct("model_id"), usage),
        one("latest_usage", F.date_format(F.max("timestamp").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), usage),
        usage.groupBy("provider").count().select(F.lit("usage_rows_by_provider"), "provider", F.col("count").cast("string")),
        one("price_intervals", F.count(F.lit(1)), prices), one("open_intervals", F.count_if(F.col("effective_to").isNull()), prices),
        one("priced_models", F.count_distinct("provider", "model_id"), prices),
    ]
    if files is not None:
        parts.append(files.groupBy("provider").count().select(F.lit("files_by_provider"), "provider", F.col("count").cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _stats() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("model_id").alias("models"),
        F.min("timestamp").alias("first_at"),
        F.max("timestamp").alias("last_at"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(usd(F.sum("exact")), F.lit(0.0)).alias("cost_usd"),
    ]


def overview(rows: DataFrame) -> DataFrame:
    return rows.agg(*_stats(), F.count_distinct("provider").alias("providers"))


def provider_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("provider").agg(*_stats()).orderBy("provider")


def top_models(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.groupBy("provider", "model_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").alias("tokens"),
        F.coalesce(usd(F.sum("exact")), F.lit(0.0)).alias("cost_usd")).orderBy(F.desc("tokens"), "provider", "model_id").limit(n)


def recent(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("timestamp"), "provider", "request_id").select("provider", "request_id", "timestamp", "model_id", "total_tokens",
        usd("exact").alias("cost_usd")).limit(n)


def price_overview(prices: DataFrame) -> DataFrame:
    """Per key: intervals, first start, last end or ``open`` where every interval is open, and its sources."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return prices.groupBy(*PRICE_KEY).agg(
        F.count(F.lit(1)).alias("intervals"), day(F.min("effective_from").cast("timestamp")).alias("first_from"),
        F.coalesce(day(F.max("effective_to").cast("timestamp")), F.lit("open")).alias("last_to"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def tail(report: DataFrame, n: int, order: str = "period") -> DataFrame:
    """The last ``n`` rows in order, after gaps are filled: a top-n per task, then one of those."""
    return report.orderBy(F.desc(order)).limit(n).orderBy(order)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` in order from 1: ranges are sorted, written with each row's place in its range, and
    ranges' counts added up, so that no task has all rows.  Ranges are drawn by sample, so they are cut once and kept."""
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "numbered")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows.orderBy(*order).select("*", F.spark_partition_id().alias("_range"), inside.alias("_at")).write.parquet(path)
    kept = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    first = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return kept.join(F.broadcast(first), "_range").select(*rows.columns, (F.col("_first") + F.col("_at") + 1).alias("place"))
