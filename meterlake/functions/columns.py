"""Scalar functions over usage columns.  Everything stays a Catalyst expression; there is no UDF here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVIDERS = ("claude-code", "codex")
FAMILIES = ("opus", "sonnet", "haiku")
CATEGORIES = ("input", "output", "cache_read", "cache_creation", "cached_input", "reasoning_output")
DIMENSIONS = ("service_tier", "speed", "region", "processing_mode", "source_detail")
PERIODS = ("5min", "hourly", "daily", "monthly", "yearly")
#: Label pattern and calendar step of each period.
LABELS = {"5min": "yyyy-MM-dd HH:mm", "hourly": "yyyy-MM-dd HH:00", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}
#: Fixed value: an RFC 3339 instant, its offset spelt out.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
#: Fixed value: the one of them that ``format_utc`` writes.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.(?!000)\d{3}|\.\d{3}(?!000)\d{3})?\+00:00\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_family(model: Column | str) -> Column:
    low = F.lower(col(model))
    out = F.when(low.contains(FAMILIES[0]), FAMILIES[0])
    for f in FAMILIES[1:]:
        out = out.when(low.contains(f), f)
    return out.otherwise("unknown")


def canonical_provider(text: Column | str) -> Column:
    t = F.lower(F.trim(col(text)))
    return F.when(t == "claude", "claude-code").when(t.isin(*PROVIDERS), t)


def format_utc(ts: Column | str) -> Column:
    """RFC 3339 with +00:00; the fraction has 0, 3 or 6 digits, as many as needed."""
    ts = col(ts)
    micro = F.date_format(ts, "SSSSSS")
    fraction = F.when(micro == "000000", "").when(micro.endswith("000"),
        F.concat(F.lit("."), F.left(micro, F.lit(3)))).otherwise(F.concat(F.lit("."), micro))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def parse_instant(text: Column | str) -> Column:
    """The instant of an RFC 3339 text that names its offset, else null."""
    t = col(text)
    return F.when(t.rlike(RFC3339), F.try_to_timestamp(t))


def utc_problem(text: Column | str) -> Column:
    """Why a text is no canonical UTC timestamp: invalid, not_utc or not_canonical; null if it is one.

    A text that has the canonical shape and names an instant is what that instant is written as, so nothing is written to see it.
    """
    t = col(text)
    utc = t.rlike(r"([Zz]|[+-]00:00)$")
    return (
        F.when(is_canonical_utc(t), F.lit(None).cast("string")).when(parse_instant(t).isNull(), "invalid").when(~utc, "not_utc")
        .otherwise("not_canonical")
    )


def is_canonical_utc(text: Column | str) -> Column:
    t = col(text)
    return F.coalesce(t.rlike(CANONICAL) & F.try_to_timestamp(t).isNotNull(), F.lit(False))


def total_tokens() -> Column:
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")


def cache_creation_total(aggregate: Column | str, five: Column | str, hour: Column | str) -> Column:
    a = F.coalesce(col(aggregate), F.lit(0))
    return F.when(a > 0, a).otherwise(F.coalesce(col(five), F.lit(0)) + F.coalesce(col(hour), F.lit(0)))


def first_present(*cols: Column | str) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*(F.when(F.trim(col(c)) != "", col(c)) for c in cols), F.lit(None).cast("string"))


def processing_mode(*cols: Column | str) -> Column:
    return F.coalesce(first_present(*cols), F.lit("standard"))


def codex_request_id(session: Column, ts_text: Column, *parts: Column) -> Column:
    return F.concat_ws(":", session, ts_text, *(p.cast("string") for p in parts))


def project_from_dir(path: Column | str) -> Column:
    """From the component after ``projects``: what follows the last ``src``, else its last part."""
    parts = F.split(col(path), "/")
    at = F.array_position(parts, "projects")
    name = F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))
    words = F.split(name, "-")
    back = F.array_position(F.reverse(words), "src")
    after = F.array_join(F.slice(words, (F.size(words) - back + 2).cast("int"), F.greatest(back - 1, F.lit(0)).cast("int")), "-")
    filled = F.filter(words, lambda w: w != "")
    return F.coalesce(F.when((back > 1) & (after != ""), after), F.try_element_at(filled, F.lit(-1)), F.lit("unknown"))


def project_from_cwd(cwd: Column | str) -> Column:
    base = F.regexp_extract(col(cwd), r"([^/\\]+)[/\\]*$", 1)
    return F.when(F.coalesce(base, F.lit("")) == "", "unknown").otherwise(base)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(col(path), "/", -1), r"\.[^.]*$", "")


def session_from_path(path: Column | str) -> Column:
    stem = file_stem(path)
    tail = F.right(stem, F.lit(36))
    dashes = F.length(tail) - F.length(F.replace(tail, F.lit("-"), F.lit("")))
    return F.when((F.length(stem) >= 36) & (dashes == 4), tail).otherwise(stem)


def is_subagent(path: Column | str) -> Column:
    return F.array_contains(F.split(col(path), "/"), "subagents")


def normalize_dimension(provider: Column | str, name: str, value: Column | str) -> Column:
    """Defaults of the first provider become null; every other value stays as it is."""
    v = col(value)
    low = F.lower(F.trim(v))
    default = {"service_tier": low == "standard", "speed": low.isin("standard", "fast"), "region": low.isin("", "not_available", "global")}.get(name)
    return v if default is None else F.when((col(provider) == "claude-code") & default, F.lit(None).cast("string")).otherwise(v)


def billable_tokens(category: str, provider: Column | str = "provider") -> Column:
    own = F.col(f"{category}_tokens")
    codex = col(provider) == "codex"
    if category == "input":
        return F.when(codex, F.greatest(own - F.col("cached_input_tokens"), F.lit(0))).otherwise(own)
    if category == "reasoning_output":
        return F.when(codex, F.lit(0)).otherwise(own)
    return own


def cost_of(tokens: Column | str, rate: Column | str) -> Column:
    """Exact USD times a million: tokens times the decimal rate per million."""
    return col(tokens).cast("decimal(20,0)") * col(rate).cast("decimal(18,6)")


def usd(exact: Column | str) -> Column:
    """Dollars as a double, to the six decimals that are printed: rounded as a decimal, so that every engine agrees."""
    return F.round(col(exact), 0).cast("double") / 1e6


def local(ts: Column | str, tz: str = "UTC") -> Column:
    return col(ts).cast("timestamp") if tz == "UTC" else F.from_utc_timestamp(col(ts).cast("timestamp"), tz)


def bucket(ts: Column | str, period: str, tz: str = "UTC") -> Column:
    """The period's label in a time zone; an unknown period gives the empty text."""
    if period not in LABELS:
        return F.lit("")
    t = local(ts, tz)
    if period == "5min":
        minute = F.floor(F.minute(t) / 5) * 5
        return F.concat(F.date_format(t, "yyyy-MM-dd HH:"), F.lpad(minute.cast("string"), 2, "0"))
    if period == "hourly":
        return F.concat(F.date_format(t, "yyyy-MM-dd HH"), F.lit(":00"))
    return F.date_format(t, LABELS[period])


def report_day(ts: Column | str, tz: str = "UTC") -> Column:
    return F.to_date(local(ts, tz))


def clamp(c: Column | str) -> Column:
    return F.greatest(col(c), F.lit(0))


def project_label(project: Column | str = "project") -> Column:
    return F.coalesce(F.nullif(col(project), F.lit("")), F.lit("unknown"))


def group_label(by: str) -> Column:
    if by == "model":
        return F.concat_ws("/", "provider", "model_id")
    return F.col("provider") if by == "provider" else project_label()


def dimension_suffix() -> Column:
    """``k=v`` of the dimensions that are set, or ``default``."""
    said = F.concat_ws(",", *(F.when(F.col(d).isNotNull(), F.concat(F.lit(f"{d}="), F.col(d))) for d in DIMENSIONS))
    return F.when(said == "", "default").otherwise(said)


def log_intensity(value: Column | str, largest: Column | str) -> Column:
    """0 to 1 on a log scale against the largest value; null for nothing."""
    v, m = col(value).cast("double"), col(largest).cast("double")
    t = F.greatest(F.ln(v) / F.when(m > 1, F.ln(m)).otherwise(1.0), F.lit(0.0))
    return F.when(v <= 0, F.lit(None).cast("double")).when(v >= m, 1.0).otherwise(t)


#: Report column names with their other names.
REPORT_COLUMNS = {
    "period": "period", "date": "period", "provider": "provider", "model": "model_id", "model_id": "model_id", "project": "project",
    "input": "input_tokens", "output": "output_tokens", "cache_creation": "cache_creation_tokens", "cache_read": "cache_read_tokens",
    "cached_input": "cached_input_tokens", "reasoning": "reasoning_output_tokens", "total": "total_tokens",
    "cost": "cost_usd", "requests": "request_count", "sessions": "session_count",
}
DEFAULT_COLUMNS = ("period", "input", "output", "total", "cost", "requests")


def report_columns(names: list[str] | None = None) -> list[str]:
    """Report columns for names or aliases; order and repeats stay, an unknown name is an error."""
    names = [n.strip().lower() for n in (names or DEFAULT_COLUMNS)]
    unknown = [n for n in names if n not in REPORT_COLUMNS]
    if unknown:
        raise ValueError(f"unknown report column: {unknown[0]}")
    return [REPORT_COLUMNS[n] for n in names]
