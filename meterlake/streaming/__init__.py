"""Usage as a stream: idempotent appends, rollups, and costs against static prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions.columns import cost_of, usd
from ..operators.components import explode_components
from ..operators.pricing import price_join
from ..operators.reports import SUMS
from ..schemas import USAGE_KEY

WINDOWS = {"5min": "5 minutes", "hourly": "1 hour", "daily": "1 day"}


def append_usage(stream: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch's records whose key is not stored yet; a repeated batch adds nothing.

    The store is laid out as ``ingest`` does, by provider and day; a batch reads the keys of its own providers only.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates(USAGE_KEY)
        try:
            stored = batch.sparkSession.read.parquet(store).select(*USAGE_KEY)
            own = [r[0] for r in fresh.select("provider").distinct().collect()]
            fresh = fresh.join(stored.filter(F.col("provider").isin(own)), USAGE_KEY, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.withColumn("usage_date", F.to_date("timestamp")).write.mode("append").partitionBy("provider", "usage_date").parquet(store)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First record per key, kept in state no longer than the watermark allows."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(USAGE_KEY)


def rollup(stream: DataFrame, period: str, delay: str = "1 hour") -> DataFrame:
    """Tumbling sums in UTC; sessions are approximate, since a stream has no exact distinct count."""
    return (
        stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", WINDOWS[period]).alias("w"))
        .agg(*(F.sum(c).alias(c) for c in SUMS), F.count(F.lit(1)).alias("request_count"),
            F.approx_count_distinct(F.struct("provider", "session_id")).alias("session_count"))
        .select(F.col("w.start").alias("period_start"), *SUMS, "request_count", "session_count")
    )


def final_rollup(stream: DataFrame, period: str, delay: str = "1 hour") -> DataFrame:
    """Tumbling sums in UTC with an exact number of sessions, each window told once, when the watermark has passed its end.

    Sessions are summed first and windows of sessions then, so state holds a row for each session of the windows that are still
    open, and is dropped with them.  Rows of windows that had ended at the watermark of the batch before do not count; ``late_rows`` says how
    many those were.
    """
    width = WINDOWS[period]
    each = stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width).alias("w"), "provider", "session_id").agg(
        *(F.sum(c).alias(c) for c in SUMS), F.count(F.lit(1)).alias("request_count"))
    whole = each.groupBy(F.window(F.window_time("w"), width).alias("w")).agg(*(F.sum(c).alias(c) for c in [*SUMS, "request_count"]),
        F.count(F.lit(1)).alias("session_count"))
    return whole.select(F.col("w.start").alias("period_start"), *SUMS, "request_count", "session_count")


def late_rows(query: StreamingQuery) -> int:
    """Groups of rows that came behind the watermark, as far back as the query keeps its progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def component_costs(stream: DataFrame, prices: DataFrame) -> DataFrame:
    """Each streamed component with the static price that applies; no price leaves its cost null."""
    return price_join(explode_components(stream), prices).select(*USAGE_KEY, "timestamp", "token_category", "component_ordinal", "tokens", "rate",
        usd(cost_of("tokens", "rate")).alias("cost_usd"))
