"""Requests to billable components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CATEGORIES, DIMENSIONS, billable_tokens, normalize_dimension
from ..schemas import PRICE_KEY

COMPONENT_COLUMNS = ["provider", "request_id", "model_id", "timestamp", "token_category", "tokens", *DIMENSIONS, "component_ordinal"]


def component_parts() -> list[tuple[str, str | None, Column]]:
    """(category, detail, tokens) of everything a request may bill, in order; cache creation splits by lifetime where the
    split is known."""
    five, hour, whole = F.col("cache_creation_5m_tokens"), F.col("cache_creation_1h_tokens"), F.col("cache_creation_tokens")
    split = (five > 0) | (hour > 0)
    parts = []
    for c in CATEGORIES:
        if c != "cache_creation":
            parts.append((c, None, billable_tokens(c)))
            continue
        # a request without the aggregate but with a split has no cache creation at all
        has = whole > 0
        parts.append((c, "ephemeral_5m", F.when(has, five).otherwise(0)))
        parts.append((c, "ephemeral_1h", F.when(has, hour).otherwise(0)))
        parts.append((c, None, F.when(split, F.greatest(whole - five - hour, F.lit(0))).otherwise(whole)))
    return [(c, detail, tokens.cast("long")) for c, detail, tokens in parts]


def component_dimensions() -> dict[str, Column]:
    """The dimensions that all of a request's components share."""
    return {d: normalize_dimension("provider", d, d) for d in DIMENSIONS[:4]}


def explode_components(usage: DataFrame) -> DataFrame:
    """One row per component: the parts of a request that have tokens, exploded in one pass.

    Parts without tokens are dropped after the explosion, since a filter of an array is not compiled; a component's ordinal is the
    number of parts with tokens before its own.
    """
    dims = [c.alias(d) for d, c in component_dimensions().items()]
    parts = component_parts()
    # tokens are worked out once, before the parts that they are told in
    told = usage.select("provider", "request_id", "model_id", "timestamp", *dims, *(tokens.alias(f"_t{i}") for i, (_, _, tokens) in enumerate(parts)))
    array = F.array(*(F.struct(F.lit(category).alias("token_category"), F.col(f"_t{i}").alias("tokens"), F.lit(detail).cast("string").alias("source_detail"))
                for i, (category, detail, _) in enumerate(parts)))
    bits = [F.when(F.col(f"_t{i}") > 0, 1 << i).otherwise(0) for i in range(len(parts))]
    before = F.bit_count(F.col("_bits").bitwiseAND(F.expr("shiftleft(1, pos) - 1")))
    return told.withColumn("_bits", sum(bits[1:], bits[0])).select("*", F.posexplode(array)).filter("col.tokens > 0").select(
        "provider", "request_id", "model_id", "timestamp", F.col("col.token_category").alias("token_category"), F.col("col.tokens").alias("tokens"),
        *DIMENSIONS[:4], F.col("col.source_detail").alias("source_detail"), before.cast("int").alias("component_ordinal"),
    )


def key_set(components: DataFrame) -> DataFrame:
    """Every pricing key that components have."""
    return components.select(*PRICE_KEY).distinct()


def expected_components(usage: DataFrame) -> DataFrame:
    """(provider, request_id, token_category, expected): what a request should bill, one pass over all categories."""
    pairs = F.array(*(F.struct(F.lit(c).alias("token_category"), billable_tokens(c).cast("long").alias("expected")) for c in CATEGORIES))
    return usage.select("provider", "request_id", F.explode(pairs).alias("e")).select("provider", "request_id", "e.token_category", "e.expected")
