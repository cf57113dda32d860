"""Usage and price tables derived from the driver's tables, by plain integer arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import classify_family, total_tokens
from ..schemas import PRICE_COLUMNS, USAGE_COLUMNS
from .catalog import expand_rates

#: Rates in USD per million tokens, as (provider, model, input, cache 5m, cache 1h, cache read, output, regional).
RATES = [
    ("claude-code", "claude-opus-4-6", "5", "6.25", "10", "0.5", "25", True),
    ("claude-code", "claude-sonnet-4-6", "3", "3.75", "6", "0.3", "15", True),
    ("claude-code", "claude-haiku-4-6", "1", "1.25", "2", "0.1", "5", True),
    ("codex", "gpt-5.5", "5", None, None, "0.5", "30", False),
    ("codex", "gpt-5.4", "2.5", None, None, "0.25", "15", False),
]
RATE_SCHEMA = "provider string, model_id string, input string, cache_5m string, cache_1h string, cache_read string, output string, regional boolean"
START, CHANGE = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 16)
SOURCES = [
    ("bundled-2024", "https://example.org/bundled", "2024-01-01", "1", "bundled", ""),
    ("reviewed-2024", "https://example.org/reviewed", "2024-01-20", "2", "reviewed", ""),
    ("manual-2023", "https://example.org/manual", "2023-06-01", "0", "manual", ""),
]
TODAY = dt.date(2024, 2, 1)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as literals, so that the optimizer knows its size."""
    names = [c.split() for c in schema.split(", ")]
    say = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in names)} FROM VALUES {values} AS t({', '.join(n for n, _ in names)})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _usage(rows: DataFrame) -> DataFrame:
    """Rows (id, ts, who, kind, amount, k) to usage; see the oracle for the same in SQL."""
    i, codex = F.col("id"), F.col("id") % 3 == 0
    claude = lambda c: F.when(codex, 0).otherwise(c).cast("long")
    own = lambda c: F.when(codex, c).otherwise(0).cast("long")
    amount, out = F.round(F.col("amount") * 100).cast("long"), (F.col("k").cast("long") * 7)
    text = lambda when, value: F.when(~codex & when, value)
    model = (
        F.when(codex & (F.col("kind") == "error"), "gpt-5.4").when(codex, "gpt-5.5").when(F.col("kind").isin("click", "view"), "claude-opus-4-6")
        .when(F.col("kind").isin("purchase", "error"), "claude-sonnet-4-6").otherwise("claude-haiku-4-6")
    )
    return rows.select(
        F.when(codex, "codex").otherwise("claude-code").alias("provider"), F.concat(F.lit("req-"), i).alias("request_id"),
        F.concat(F.lit("sess-"), "who").alias("session_id"),
        F.concat(F.lit("uuid-"), i).alias("uuid"), F.col("ts").cast("timestamp").alias("timestamp"), model.alias("model_id"),
        amount.alias("input_tokens"), out.alias("output_tokens"), claude((i % 5) * 100).alias("cache_creation_tokens"),
        claude((i % 11) * 1000).alias("cache_read_tokens"),
        own(F.least(amount, (i % 4) * 500)).alias("cached_input_tokens"), own(F.least(out, i % 50)).alias("reasoning_output_tokens"),
        claude(F.when(i % 5 == 2, 100).otherwise(0)).alias("cache_creation_5m_tokens"),
        claude(F.when(i % 5 == 3, 50).otherwise(0)).alias("cache_creation_1h_tokens"),
        text(i % 10 == 0, "standard").alias("service_tier"), text(i % 7 == 0, "fast").alias("speed"),
        text(i % 13 == 0, "us").when(~codex & (i % 13 == 1), "not_available").alias("region"), F.when(codex, "standard").alias("processing_mode"),
        F.when(F.col("who") % 5 == 0, "").otherwise(F.concat(F.lit("proj-"), (F.col("who") % 5).cast("string"))).alias("project"),
        F.concat(F.lit("/logs/"), "who", F.lit(".jsonl")).alias("source_file"), (i % 6 == 0).alias("is_subagent"),
    ).withColumn("model_family", classify_family("model_id")).withColumn("total_tokens", total_tokens()).select(*USAGE_COLUMNS)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return _usage(events(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("who"), F.col("event_type").alias("kind"),
            F.col("value").alias("amount"), k.alias("k")))


def usage_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bridge over line items, for runs with more rows."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("signup", "error", "click", "view", "purchase"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(l_orderkey % 30 as int), cast(l_suppkey % 24 as int), cast(l_partkey % 60 as int), 0)").alias("ts"),
        (F.col("l_suppkey") % 150).alias("who"), kinds.alias("kind"), (F.col("l_extendedprice") % 400).alias("amount"),
        (F.col("l_partkey") % 100).alias("k"),
    )
    return _usage(rows)


def rates(spark: SparkSession) -> DataFrame:
    return inline(spark, RATES, RATE_SCHEMA)


def prices(spark: SparkSession) -> DataFrame:
    """Open prices of every bridged model from the first day; one input rate changes mid-month."""
    expanded = expand_rates(rates(spark), START, "bundled-2024")
    change = (F.col("model_id") == "claude-opus-4-6") & (F.col("token_category") == "input") & F.col("region").isNull()
    old = expanded.withColumn("effective_to", F.when(change, F.lit(CHANGE).cast("timestamp")))
    new = expanded.filter(change).withColumns({"rate_per_1m_tokens": (F.col("rate_per_1m_tokens") * 2).cast("decimal(18,6)"),
            "effective_from": F.lit(CHANGE).cast("timestamp"), "source": F.lit("reviewed-2024")})
    return old.unionByName(new).select(*PRICE_COLUMNS)


def defective_prices(spark: SparkSession) -> DataFrame:
    """The same prices with a gap, an overlap, a missing key, a EUR row, and a source that nobody knows."""
    p, m, c, plain = prices(spark), F.col("model_id"), F.col("token_category"), F.col("region").isNull()
    at = lambda d: F.lit(dt.datetime(2024, 1, d)).cast("timestamp")
    gap = (m == "claude-haiku-4-6") & (c == "output") & plain
    overlap = (m == "claude-sonnet-4-6") & (c == "input") & plain
    euro = (m == "gpt-5.4") & (c == "output")
    late = (m == "gpt-5.4") & (c == "input")
    kept = p.filter(~((m == "gpt-5.5") & (c == "cached_input")))
    base = kept.withColumns({
        "effective_to": F.when(gap, at(10)).otherwise(F.col("effective_to")), "currency": F.when(euro, "EUR").otherwise(F.col("currency")),
        "effective_from": F.when(late, at(5)).otherwise(F.col("effective_from")), "source": F.when(late, "nobody").otherwise(F.col("source")),
    })
    after = kept.filter(gap).withColumns({"effective_from": at(12), "effective_to": at(20)})
    twice = kept.filter(overlap).withColumns({"effective_from": at(20), "source": F.lit("manual-2023")})
    return base.unionByName(after).unionByName(twice)


def sources(spark: SparkSession) -> DataFrame:
    return inline(spark, SOURCES,
        "source string, source_url string, source_retrieved_at string, catalog_version string, source_kind string, notes string")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price history from line items: effective-dated rates per part and category, with gaps, overlaps and other currencies."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    start = F.col("l_shipdate").cast("timestamp")
    none = F.lit(None).cast("string")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(F.col("l_partkey") % 2 == 0, "codex").otherwise("claude-code").alias("provider"),
        F.concat(F.lit("part-"), (F.col("l_partkey") % 500).cast("string")).alias("model_id"),
        F.element_at(F.array(F.lit("input"), F.lit("output"), F.lit("cache_read"), F.lit("cache_creation"), F.lit("cached_input"),
                F.lit("reasoning_output")), (n % 6 + 1).cast("int")).alias("token_category"),
        none.alias("service_tier"), none.alias("speed"), F.when(k % 4 == 0, "us").alias("region"), none.alias("processing_mode"),
        none.alias("source_detail"),
        F.when(k % 97 == 0, "EUR").otherwise("USD").alias("currency"), F.col("l_extendedprice").cast("decimal(18,6)").alias("rate_per_1m_tokens"),
        start.alias("effective_from"),
        F.when(k % 17 != 0, start + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("effective_to"),
        F.concat(F.lit("src-"), (F.col("l_suppkey") % 5).cast("string")).alias("source"),
    )
