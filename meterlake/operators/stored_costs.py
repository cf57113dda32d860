"""Request costs kept on disk, of which a change of prices computes only the days that it touches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PRICE_COLUMNS, PRICES, USAGE_KEY
from ..sources.logs import stored_table
from .pricing import priced_usage, with_usd

COSTS = "request_id string, exact decimal(38,6), status string, pricing_generation long, provider string, usage_date date"
#: Fixed value: a day that no price lasts beyond.
EVER = dt.date(9999, 12, 31)


def stored_costs(spark: SparkSession, store: str) -> DataFrame:
    """(provider, usage_date, request_id, exact, status, pricing_generation)"""
    return stored_table(spark, f"{store}/costs", COSTS)


def stored_prices(spark: SparkSession, store: str) -> tuple[int, DataFrame]:
    """The generation of prices that stored costs follow, 0 before the first one, and these prices."""
    rows = stored_table(spark, f"{store}/prices", f"{PRICES}, generation long")
    now = rows.agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]
    return now, rows.filter(F.col("generation") == now).select(*PRICE_COLUMNS)


def changed_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """(provider, since, until): the days, both included, on which a price holds that only one side has."""
    a, b = old.select(*PRICE_COLUMNS), new.select(*PRICE_COLUMNS)
    either = a.exceptAll(b).unionByName(b.exceptAll(a)).filter("currency = 'USD'")
    last = F.coalesce(F.to_date(F.col("effective_to") - F.expr("interval 1 microsecond")), F.lit(EVER))
    return either.select("provider", F.to_date("effective_from").alias("since"), last.alias("until")).distinct()


def dirty_days(usage: DataFrame, changes: DataFrame) -> DataFrame:
    """(provider, usage_date) of usage that a change touches."""
    days = usage.select("provider", F.to_date("timestamp").alias("usage_date")).distinct()
    meets = (F.col("d.provider") == F.col("c.provider")) & F.col("d.usage_date").between(F.col("c.since"), F.col("c.until"))
    return days.alias("d").join(changes.alias("c"), meets, "left_semi")


def _write(rows: DataFrame, store: str, mode: str) -> None:
    # a busy day is split over several tasks and files; no session setting says which partitions are replaced
    rows.hint("rebalance", "provider", "usage_date").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("provider", "usage_date").parquet(
        f"{store}/costs")


def _costs(usage: DataFrame, prices: DataFrame, generation: int) -> DataFrame:
    return priced_usage(usage, prices).select("request_id", "exact", "status", F.lit(generation).cast("long").alias("pricing_generation"), "provider",
        F.to_date("timestamp").alias("usage_date"))


def reprice_stored(usage: DataFrame, prices: DataFrame, store: str) -> int:
    """Bring stored costs in line with ``prices``; returns the generation that they follow now.

    Only partitions (provider and day) that a changed price touches are computed and replaced; the others keep their
    files.  The new prices are stored after the costs: a run that is lost in between finds the old prices again, and does
    the same once more.
    """
    spark = usage.sparkSession
    generation, old = stored_prices(spark, store)
    changes = changed_prices(old, prices)
    if generation and changes.isEmpty():
        return generation
    rows = usage.withColumn("usage_date", F.to_date("timestamp")).filter("provider is not null and usage_date is not null")
    if generation:
        # a row per provider and day at most; usage is not dealt by day, of which there may be few and busy ones
        rows = rows.join(F.broadcast(dirty_days(usage, changes)), ["provider", "usage_date"], "left_semi")
    rows = rows.drop("usage_date")
    _write(_costs(rows, prices, generation + 1), store, "overwrite")
    prices.select(*PRICE_COLUMNS).hint("rebalance").write.mode("overwrite").parquet(f"{store}/prices/generation={generation + 1}")
    return generation + 1


def cost_new(usage: DataFrame, store: str) -> None:
    """Costs of requests that have none yet, at the stored prices, beside those that are there."""
    spark = usage.sparkSession
    generation, prices = stored_prices(spark, store)
    fresh = usage.join(stored_costs(spark, store).select(*USAGE_KEY), USAGE_KEY, "left_anti")
    _write(_costs(fresh, prices, generation), store, "append")


def costed(usage: DataFrame, store: str) -> DataFrame:
    """Usage with its stored cost in dollars, and status ``absent`` where it has none."""
    costs = with_usd(stored_costs(usage.sparkSession, store)).drop("usage_date")
    return usage.join(costs, USAGE_KEY, "left").withColumn("status", F.coalesce("status", F.lit("absent")))
