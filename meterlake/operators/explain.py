"""How certain a cost is, and what it rests on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import usd
from ..schemas import USAGE_KEY
from .pricing import price_join

STALE_DAYS = 90


def component_count(usage: DataFrame, components: DataFrame) -> DataFrame:
    return components.join(usage.select(*USAGE_KEY), USAGE_KEY).agg(F.count(F.lit(1)).alias("component_count"))


def provenance(usage: DataFrame, components: DataFrame, prices: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct component keys with the source of their price and what is known of that source."""
    own = components.join(usage.select(*USAGE_KEY), USAGE_KEY, "left_semi")
    meta = sources.select(F.col("source").alias("s_source"), "source_kind", "source_retrieved_at")
    keys = ["provider", "model_id", "token_category", "service_tier", "speed", "region", "processing_mode"]
    # reduced to distinct keys before the join with the sources
    priced = price_join(own, prices).select(*keys, "price_source").distinct()
    return priced.join(meta, F.col("price_source") == F.col("s_source"), "left").select(*keys, F.col("price_source").alias("source"), "source_kind",
        "source_retrieved_at").distinct()


def assumptions(rows: DataFrame, today: dt.date) -> DataFrame:
    """What each provenance row assumes, without repeats, in order."""
    cutoff = F.lit(today - dt.timedelta(days=STALE_DAYS))
    claude, codex = F.col("provider") == "claude-code", F.col("provider") == "codex"
    none = F.lit(None).cast("string")

    def said(when, kind: str, dimension=none, source=none):
        return F.when(when, F.struct(F.lit(kind).alias("kind"), dimension.alias("dimension"), source.alias("source")))

    src = F.col("source")
    kinds = [
        *(said(claude & F.col(d).isNull(), "default_modifier", F.lit(d)) for d in ("service_tier", "speed", "region")),
        said(codex & (F.col("processing_mode") == "standard"), "default_modifier", F.lit("processing_mode")),
        said(F.col("source_kind") == "bundled", "bundled_source", none, src),
        said(src.isNotNull() & F.col("source_kind").isNull(), "missing_source_metadata", none, src),
        said(F.try_to_date("source_retrieved_at", "yyyy-MM-dd") < cutoff, "stale_source", none, src),
    ]
    out = rows.select("provider", "model_id", "token_category", F.explode(F.filter(F.array(*kinds), lambda a: a.isNotNull())).alias("a"))
    return out.select("a.kind", "provider", "model_id", "token_category", "a.dimension", "a.source").distinct().orderBy("kind", "provider",
        "model_id", "token_category", "dimension", "source")


def explain_cost(usage: DataFrame, costs: DataFrame, components: DataFrame, prices: DataFrame, sources: DataFrame, today: dt.date) -> DataFrame:
    """One row: confidence (high where nothing is assumed), cost, components and number of assumptions."""
    found = assumptions(provenance(usage, components, prices, sources), today).agg(F.count(F.lit(1)).alias("assumption_count"))
    cost = usage.select(*USAGE_KEY).join(costs, USAGE_KEY).agg(F.coalesce(usd(F.sum("exact")), F.lit(0.0)).alias("cost_usd"))
    # three one-row results side by side
    return cost.join(F.broadcast(component_count(usage, components))).join(F.broadcast(found)).select(
        F.when(F.col("assumption_count") == 0, "high").otherwise("estimated").alias("confidence"), "cost_usd", "component_count", "assumption_count"
    )
