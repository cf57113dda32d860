"""DuckDB SQL for the registered queries: shared common table expressions, then one SELECT per query."""

from __future__ import annotations

from decimal import Decimal

from ..sources.bridge import RATES, SOURCES

USAGE = """
ev AS (SELECT event_id AS id, ts, user_id AS who, event_type AS kind, value AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
usage AS (
  SELECT *, CASE WHEN model_id LIKE '%opus%' THEN 'opus' WHEN model_id LIKE '%sonnet%' THEN 'sonnet' WHEN model_id LIKE '%haiku%' THEN 'haiku' ELSE 'unknown' END AS model_family,
    input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens AS total_tokens
  FROM (SELECT
    CASE WHEN id % 3 = 0 THEN 'codex' ELSE 'claude-code' END AS provider, 'req-' || id AS request_id, 'sess-' || who AS session_id, ts AS "timestamp",
    CASE WHEN id % 3 = 0 AND kind = 'error' THEN 'gpt-5.4' WHEN id % 3 = 0 THEN 'gpt-5.5' WHEN kind IN ('click', 'view') THEN 'claude-opus-4-6' WHEN kind IN ('purchase', 'error') THEN 'claude-sonnet-4-6' ELSE 'claude-haiku-4-6' END AS model_id,
    CAST(ROUND(amount * 100) AS BIGINT) AS input_tokens, k * 7 AS output_tokens,
    CASE WHEN id % 3 = 0 THEN 0 ELSE (id % 5) * 100 END AS cache_creation_tokens, CASE WHEN id % 3 = 0 THEN 0 ELSE (id % 11) * 1000 END AS cache_read_tokens,
    CASE WHEN id % 3 = 0 THEN least(CAST(ROUND(amount * 100) AS BIGINT), (id % 4) * 500) ELSE 0 END AS cached_input_tokens, CASE WHEN id % 3 = 0 THEN least(k * 7, id % 50) ELSE 0 END AS reasoning_output_tokens,
    CASE WHEN id % 3 <> 0 AND id % 5 = 2 THEN 100 ELSE 0 END AS c5, CASE WHEN id % 3 <> 0 AND id % 5 = 3 THEN 50 ELSE 0 END AS c1,
    CASE WHEN id % 3 <> 0 AND id % 10 = 0 THEN 'standard' END AS service_tier, CASE WHEN id % 3 <> 0 AND id % 7 = 0 THEN 'fast' END AS speed,
    CASE WHEN id % 3 <> 0 AND id % 13 = 0 THEN 'us' WHEN id % 3 <> 0 AND id % 13 = 1 THEN 'not_available' END AS region, CASE WHEN id % 3 = 0 THEN 'standard' END AS processing_mode,
    CASE WHEN who % 5 = 0 THEN '' ELSE 'proj-' || (who % 5) END AS project, id % 6 = 0 AS is_subagent
  FROM ev))"""

# line items repeat (order, line), so a row number tells requests apart
SCALED = USAGE.replace("'req-' || id AS request_id", "'req-' || id || '-' || rid AS request_id").replace(USAGE[: USAGE.index("usage AS (")], """
ev AS (SELECT row_number() OVER () AS rid, l_orderkey * 8 + l_linenumber AS id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(l_orderkey % 30 AS INTEGER)) + to_hours(l_suppkey % 24) + to_minutes(l_partkey % 60) AS ts, l_suppkey % 150 AS who,
  ['signup', 'error', 'click', 'view', 'purchase'][l_linenumber % 5 + 1] AS kind, l_extendedprice % 400 AS amount, l_partkey % 100 AS k FROM lineitem),
""")

COMPONENTS = """
parts AS (
  SELECT *, unnest([
    {'o': 0, 'cat': 'input', 'n': CASE WHEN provider = 'codex' THEN greatest(input_tokens - cached_input_tokens, 0) ELSE input_tokens END, 'd': NULL},
    {'o': 1, 'cat': 'output', 'n': output_tokens, 'd': NULL}, {'o': 2, 'cat': 'cache_read', 'n': cache_read_tokens, 'd': NULL},
    {'o': 3, 'cat': 'cache_creation', 'n': CASE WHEN cache_creation_tokens > 0 THEN c5 ELSE 0 END, 'd': 'ephemeral_5m'}, {'o': 4, 'cat': 'cache_creation', 'n': CASE WHEN cache_creation_tokens > 0 THEN c1 ELSE 0 END, 'd': 'ephemeral_1h'},
    {'o': 5, 'cat': 'cache_creation', 'n': greatest(cache_creation_tokens - c5 - c1, 0), 'd': NULL}, {'o': 6, 'cat': 'cached_input', 'n': cached_input_tokens, 'd': NULL},
    {'o': 7, 'cat': 'reasoning_output', 'n': CASE WHEN provider = 'codex' THEN 0 ELSE reasoning_output_tokens END, 'd': NULL}]) AS p
  FROM usage),
components AS (
  SELECT provider, request_id, model_id, "timestamp", p.cat AS token_category, CAST(p.n AS BIGINT) AS tokens,
    CASE WHEN provider = 'claude-code' AND lower(trim(service_tier)) = 'standard' THEN NULL ELSE service_tier END AS service_tier,
    CASE WHEN provider = 'claude-code' AND lower(trim(speed)) IN ('standard', 'fast') THEN NULL ELSE speed END AS speed,
    CASE WHEN provider = 'claude-code' AND lower(trim(region)) IN ('', 'not_available', 'global') THEN NULL ELSE region END AS region,
    processing_mode, p.d AS source_detail, row_number() OVER (PARTITION BY provider, request_id ORDER BY p.o) - 1 AS component_ordinal
  FROM parts WHERE p.n > 0)"""


def _price_rows() -> list[tuple]:
    out = []
    for provider, model, inp, c5, c1, read, outp, regional in RATES:
        mode = "standard" if provider == "codex" else None
        cats = [("input", None, inp), ("output", None, outp)]
        if provider == "codex":
            cats += [("cached_input", None, read), ("reasoning_output", None, outp)]
        else:
            cats += [("cache_read", None, read), ("cache_creation", None, c5), ("cache_creation", "ephemeral_5m", c5),
                ("cache_creation", "ephemeral_1h", c1)]
        for cat, detail, rate in cats:
            out.append((provider, model, cat, None, mode, detail, "USD", Decimal(rate), "2024-01-01", None, "bundled-2024"))
            if regional:
                out.append((provider, model, cat, "us", mode, detail, "USD", Decimal(rate) * Decimal("1.1"), "2024-01-01", None, "bundled-2024"))
    return out


def _values(rows: list[tuple]) -> str:
    def one(i: int, x) -> str:
        if i == 7:
            return f"CAST({x} AS DECIMAL(18,6))"
        if i in (8, 9):
            return "CAST(NULL AS TIMESTAMP)" if x is None else f"TIMESTAMP '{x} 00:00:00'"
        return "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"

    return ",\n".join("(" + ", ".join(one(i, x) for i, x in enumerate(r)) + ")" for r in rows)


def price_cte(rows: list[tuple]) -> str:
    names = "provider, model_id, token_category, region, processing_mode, source_detail, currency, rate, effective_from, effective_to, source"
    return f"prices AS (SELECT *, CAST(NULL AS VARCHAR) AS service_tier, CAST(NULL AS VARCHAR) AS speed FROM (VALUES {_values(rows)}) AS v({names}))"


def good_prices() -> list[tuple]:
    out = []
    for r in _price_rows():
        if r[1] == "claude-opus-4-6" and r[2] == "input" and r[3] is None:
            out += [(*r[:9], "2024-01-16", r[10]), (*r[:7], r[7] * 2, "2024-01-16", None, "reviewed-2024")]
        else:
            out.append(r)
    return out


def defective_prices() -> list[tuple]:
    out = []
    for r in good_prices():
        model, cat, plain = r[1], r[2], r[3] is None
        if model == "gpt-5.5" and cat == "cached_input":
            continue
        if model == "claude-haiku-4-6" and cat == "output" and plain:
            out += [(*r[:9], "2024-01-10", r[10]), (*r[:8], "2024-01-12", "2024-01-20", r[10])]
        elif model == "claude-sonnet-4-6" and cat == "input" and plain:
            out += [r, (*r[:8], "2024-01-20", None, "manual-2023")]
        elif model == "gpt-5.4" and cat == "output":
            out.append((*r[:6], "EUR", *r[7:]))
        elif model == "gpt-5.4" and cat == "input":
            out.append((*r[:8], "2024-01-05", r[9], "nobody"))
        else:
            out.append(r)
    return out


MATCH = """p.provider = c.provider AND p.model_id = c.model_id AND p.token_category = c.token_category AND p.service_tier IS NOT DISTINCT FROM c.service_tier
  AND p.speed IS NOT DISTINCT FROM c.speed AND p.region IS NOT DISTINCT FROM c.region AND p.processing_mode IS NOT DISTINCT FROM c.processing_mode AND p.source_detail IS NOT DISTINCT FROM c.source_detail"""
IN_FORCE = """p.effective_from <= c."timestamp" AND (p.effective_to IS NULL OR c."timestamp" < p.effective_to)"""

COSTS = f"""
matches AS (
  SELECT c.provider, c.request_id, c.component_ordinal, count(p.rate) AS price_matches, CASE WHEN count(p.rate) = 1 THEN sum(CAST(c.tokens AS DECIMAL(20,0)) * p.rate) END AS exact
  FROM components c LEFT JOIN prices p ON {MATCH} AND p.currency = 'USD' AND {IN_FORCE} GROUP BY ALL),
per AS (
  SELECT provider, request_id, count(*) AS n, count(*) FILTER (price_matches = 1) AS priced, count(*) FILTER (price_matches > 1) AS ambiguous, sum(exact) AS exact FROM matches GROUP BY ALL),
stated AS (
  SELECT u.provider, u.request_id, per.exact, CASE WHEN coalesce(ambiguous, 0) > 0 THEN 'ambiguous'
    WHEN n IS NULL AND input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + cached_input_tokens + reasoning_output_tokens > 0 THEN 'integrity'
    WHEN coalesce(priced, 0) < coalesce(n, 0) THEN 'missing' ELSE 'priced' END AS status
  FROM usage u LEFT JOIN per USING (provider, request_id)),
costs AS (SELECT provider, request_id, status, CASE WHEN status = 'priced' THEN coalesce(exact, 0) END AS exact FROM stated),
rows AS (SELECT usage.*, costs.exact FROM usage LEFT JOIN costs USING (provider, request_id))"""

SOURCE_CTE = "sources AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in s) + ")" for s in SOURCES) + ") AS v(source, source_url, source_retrieved_at, catalog_version, source_kind, notes))"

QUOTES = """
prices AS (SELECT
  CASE WHEN l_partkey % 2 = 0 THEN 'codex' ELSE 'claude-code' END AS provider, 'part-' || (l_partkey % 500) AS model_id,
  ['input', 'output', 'cache_read', 'cache_creation', 'cached_input', 'reasoning_output'][l_linenumber % 6 + 1] AS token_category, CAST(NULL AS VARCHAR) AS service_tier, CAST(NULL AS VARCHAR) AS speed,
  CASE WHEN l_orderkey % 4 = 0 THEN 'us' END AS region, CAST(NULL AS VARCHAR) AS processing_mode, CAST(NULL AS VARCHAR) AS source_detail, CASE WHEN l_orderkey % 97 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CAST(l_extendedprice AS DECIMAL(18,6)) AS rate, CAST(l_shipdate AS TIMESTAMP) AS effective_from,
  CASE WHEN l_orderkey % 17 <> 0 THEN CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(l_quantity AS INTEGER)) END AS effective_to, 'src-' || (l_suppkey % 5) AS source
  FROM lineitem)"""
KEY = "provider, model_id, token_category, service_tier, speed, region, processing_mode, source_detail"

SUMS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cached_input_tokens", "reasoning_output_tokens",
    "total_tokens"]
USD = "CAST(round(coalesce(sum(exact), 0), 0) AS DOUBLE) / 1e6"
MEASURES = ", ".join(f"CAST(greatest(coalesce(sum({c}), 0), 0) AS BIGINT) AS {c}" for c in SUMS) + f", {USD} AS cost_usd, count(*) AS request_count, count(DISTINCT (provider, session_id)) AS session_count"
ZEROS = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*SUMS, "cost_usd", "request_count", "session_count"])
DIMS = """CASE WHEN concat_ws(',', 'service_tier=' || service_tier, 'speed=' || speed, 'region=' || region, 'processing_mode=' || processing_mode, 'source_detail=' || source_detail) = '' THEN 'default'
  ELSE concat_ws(',', 'service_tier=' || service_tier, 'speed=' || speed, 'region=' || region, 'processing_mode=' || processing_mode, 'source_detail=' || source_detail) END"""


def base(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


def priced(select: str, *more: str) -> str:
    """Usage, components, good prices and costs, then ``select``."""
    return base(USAGE, COMPONENTS, price_cte(good_prices()), COSTS, *more) + "\n" + select


def scaled(select: str) -> str:
    """``priced`` over line items."""
    return base(SCALED, COMPONENTS, price_cte(good_prices()), COSTS) + "\n" + select


def defective(select: str, *more: str) -> str:
    return base(USAGE, COMPONENTS, price_cte(defective_prices()), COSTS, SOURCE_CTE, *more) + "\n" + select


def bucket(period: str, tz: str | None = None) -> str:
    t = '"timestamp"' if tz is None else f"(\"timestamp\" AT TIME ZONE 'UTC' AT TIME ZONE '{tz}')"
    return {
        "5min": f"strftime({t}, '%Y-%m-%d %H:') || lpad(CAST(floor(minute({t}) / 5) * 5 AS INTEGER)::VARCHAR, 2, '0')",
        "hourly": f"strftime({t}, '%Y-%m-%d %H:00')",
        "daily": f"strftime({t}, '%Y-%m-%d')", "monthly": f"strftime({t}, '%Y-%m')", "yearly": f"strftime({t}, '%Y')",
    }[period]


def said(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def finding(severity: str, kind: str, start: str = "NULL", end: str = "NULL", remedy: str = "''", dims: str = DIMS) -> str:
    return f"{severity} AS severity, {kind} AS kind, provider, model_id, token_category, {dims} AS dimensions, CAST({start} AS VARCHAR) AS \"start\", CAST({end} AS VARCHAR) AS \"end\", {remedy} AS remediation"
