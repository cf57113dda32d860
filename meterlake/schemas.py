"""Schemas of the usage model."""

from __future__ import annotations

USAGE = (
    "provider string, request_id string, session_id string, uuid string, timestamp timestamp, model_family string, model_id string, "
    "input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cached_input_tokens long, "
    "reasoning_output_tokens long, cache_creation_5m_tokens long, cache_creation_1h_tokens long, service_tier string, speed string, "
    "region string, processing_mode string, project string, source_file string, is_subagent boolean, total_tokens long"
)
USAGE_COLUMNS = [c.split()[0] for c in USAGE.split(", ")]
USAGE_KEY = ["provider", "request_id"]
TOKEN_COLUMNS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cached_input_tokens", "reasoning_output_tokens"]

PRICES = (
    "provider string, model_id string, token_category string, service_tier string, speed string, region string, processing_mode string, "
    "source_detail string, currency string, rate_per_1m_tokens decimal(18,6), effective_from timestamp, effective_to timestamp, source string"
)
PRICE_COLUMNS = [c.split()[0] for c in PRICES.replace("(18,6)", "").split(", ")]
PRICE_KEY = ["provider", "model_id", "token_category", "service_tier", "speed", "region", "processing_mode", "source_detail"]

SOURCES = "source string, source_url string, source_retrieved_at string, catalog_version string, source_kind string, notes string"
FINDING_COLUMNS = ["severity", "kind", "provider", "model_id", "token_category", "dimensions", "start", "end", "remediation"]
