"""Audits: price timelines, coverage of usage, billing components, sources.  Findings are rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import CATEGORIES, DIMENSIONS, PROVIDERS, billable_tokens, dimension_suffix, is_canonical_utc, parse_instant
from ..schemas import PRICE_KEY, USAGE_KEY
from .components import expected_components, key_set
from .explain import STALE_DAYS
from .pricing import in_force, same_key
from .reports import numbered

SEVERITIES = ("Info", "Warning", "Error")


def text_of(ts: Column) -> Column:
    """Instants as text, so that findings about unreadable ones fit the same column."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def finding(severity: Column | str, kind: Column | str, start: Column | None = None, end: Column | None = None, remedy: str = "") -> list[Column]:
    none = F.lit(None).cast("string")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [lit(severity).alias("severity"), lit(kind).alias("kind"), "provider", "model_id", "token_category",
        dimension_suffix().alias("dimensions"), (none if start is None else start).alias("start"), (none if end is None else end).alias("end"),
        F.lit(remedy).alias("remediation")]


# -- price timelines

def adjacent_pairs(prices: DataFrame) -> DataFrame:
    """Neighbouring intervals of a key that leave a gap or overlap."""
    w = Window.partitionBy(*PRICE_KEY, "currency").orderBy("effective_from", F.col("effective_to").asc_nulls_last(), "rate_per_1m_tokens", "source")
    nxt = F.lead("effective_from").over(w)
    rows = prices.withColumn("next_from", nxt).filter("next_from is not null")
    to = F.col("effective_to")
    kind = F.when(to.isNull() | (to > F.col("next_from")), "Overlap").when(to < F.col("next_from"), "Gap")
    rows = rows.withColumn("_kind", kind).filter("_kind is not null")
    first, last = F.when(F.col("_kind") == "Gap", to).otherwise(F.col("next_from")), F.when(F.col("_kind") == "Gap", F.col("next_from")).otherwise(to)
    return rows.select(*finding("Error", F.col("_kind"), text_of(first), text_of(last), "let each interval end where the next one begins"))


def open_intervals(prices: DataFrame) -> DataFrame:
    """Keys without an open interval, or with several."""
    n = F.count_if(F.col("effective_to").isNull())
    rows = prices.groupBy(*PRICE_KEY, "currency").agg(n.alias("n")).filter("n != 1")
    return rows.select(*finding(F.when(F.col("n") == 0, "Warning").otherwise("Error"),
            F.when(F.col("n") == 0, "MissingCurrent").otherwise("DuplicateCurrent"), remedy="keep one open interval per key"))


def currencies(prices: DataFrame) -> DataFrame:
    return prices.filter("currency != 'USD'").select(*finding("Error", "UnsupportedCurrency", text_of(F.col("effective_from")),
            text_of(F.col("effective_to")), "price in USD"))


def price_row_problems(raw: DataFrame) -> DataFrame:
    """Problems of raw price rows, all columns being text: several per row are possible."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    c = F.col
    rate = c("_rate")
    start, end = parse_instant("effective_from"), parse_instant("effective_to")
    checks = [
        *(F.when(blank(c(x)), F.lit(f"blank {x}")) for x in ("provider", "model_id", "token_category", "currency", "source")),
        *(F.when(c(d).isNotNull() & blank(c(d)), F.lit(f"blank {d}")) for d in DIMENSIONS),
        F.when(rate.isNull() | F.isnan(rate), F.lit("rate is no number")), F.when(rate < 0, F.lit("rate is negative")),
        F.when(~blank(c("provider")) & ~c("provider").isin(*PROVIDERS), F.lit("unsupported provider")),
        F.when(~blank(c("token_category")) & ~c("token_category").isin(*CATEGORIES), F.lit("unsupported category")),
        F.when(~is_canonical_utc("effective_from"), F.lit("effective_from is not canonical")),
        F.when(c("effective_to").isNotNull() & ~is_canonical_utc("effective_to"), F.lit("effective_to is not canonical")),
        F.when(end <= start, F.lit("effective_to is not after effective_from")),
    ]
    # checks that found nothing are dropped after the explosion: a filter of an array is not compiled
    rated = raw.withColumn("_rate", c("rate_per_1m_tokens").try_cast("double"))
    return rated.select("*", F.explode(F.array(*checks)).alias("problem")).filter("problem is not null").drop("_rate")


def malformed_prices(raw: DataFrame) -> DataFrame:
    return price_row_problems(raw).select(*finding("Error", "MalformedCatalogRow", F.col("effective_from"), F.col("effective_to")),
        "problem").withColumn("remediation", F.col("problem")).drop("problem")


# -- usage against prices

def observations(components: DataFrame) -> DataFrame:
    """First and last use of every pricing key."""
    return components.groupBy(*PRICE_KEY).agg(F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def usage_row_problems(raw: DataFrame) -> DataFrame:
    """Rows (provider, model_id, token_category, timestamp as text, dimensions) that no audit can place."""
    checks = [
        F.when(~F.coalesce(F.col("provider"), F.lit("")).isin(*PROVIDERS), F.lit("UnsupportedProvider")),
        F.when(~F.coalesce(F.col("token_category"), F.lit("")).isin(*CATEGORIES), F.lit("UnsupportedCategory")),
        F.when(~is_canonical_utc("timestamp"), F.lit("MalformedUsageTimestamp")),
    ]
    rows = raw.select("*", F.explode(F.array(*checks)).alias("_kind")).filter("_kind is not null")
    return rows.select(*finding("Error", F.col("_kind"), F.col("timestamp"), remedy="correct or remove the usage row"))


def coverage(seen: DataFrame, prices: DataFrame) -> DataFrame:
    """Where prices do not cover a key from its first to its last use (``observations``).

    The cursor of a sweep over the intervals is a running maximum: of the first use and all earlier ends.
    """
    usd_prices = prices.filter("currency = 'USD'").select(*PRICE_KEY, "effective_from", "effective_to")
    both = seen.alias("c").join(usd_prices.withColumn("currency", F.lit("USD")).alias("p"), same_key("c", "p"), "left").select("c.*",
        "p.effective_from", "p.effective_to")
    w = Window.partitionBy(*PRICE_KEY).orderBy("effective_from", F.col("effective_to").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    swept = (
        both.withColumn("cursor", F.greatest("first_at", F.max("effective_to").over(before)))
        .withColumn("open_before", F.coalesce(F.max(F.col("effective_to").isNull() & F.col("effective_from").isNotNull()).over(before), F.lit(False)))
        .withColumn("nth", F.row_number().over(w)).withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
        .withColumn("any_open", F.max(F.col("effective_to").isNull()).over(Window.partitionBy(*PRICE_KEY)))
        .withColumn("end_cursor", F.greatest("cursor", "effective_to"))
    )
    start, last = F.col("effective_from"), F.col("last_at")
    said = lambda k, a, b: F.struct(F.lit(k).alias("kind"), text_of(a).alias("a"), text_of(b).alias("b"))
    kinds = F.array(
        F.when(start.isNull(), said("MissingCoverage", F.col("first_at"), last)),
        F.when((F.col("nth") == 1) & (start > F.col("first_at")), said("UsageBeforeFirstInterval", F.col("first_at"), start)),
        F.when(~F.col("open_before") & (start > F.col("cursor")) & (F.col("cursor") <= last), said("MissingCoverage", F.col("cursor"), start)),
        F.when(F.col("is_last") & start.isNotNull() & ~F.col("any_open") & (F.col("end_cursor") <= last),
            said("UsageAfterLastInterval", F.col("end_cursor"), last)),
    )
    rows = swept.select(*PRICE_KEY, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("f"))
    return rows.select(*finding("Error", F.col("f.kind"), F.col("f.a"), F.col("f.b"), "add a price for the uncovered time"))


def unknown_models(components: DataFrame, prices: DataFrame) -> DataFrame:
    """Observed models without any price row."""
    models = components.select("provider", "model_id").distinct()
    none = {c: F.lit(None).cast("string") for c in ("token_category", *DIMENSIONS)}
    return models.join(prices.select("provider", "model_id").distinct(), ["provider", "model_id"],
        "left_anti").withColumns(none).select(*finding("Error", "UnknownObservedModel", remedy="add prices for the model"))


def unsupported_modifiers(components: DataFrame, prices: DataFrame) -> DataFrame:
    """Observed non-default dimensions that no price row of the key has, at any date."""
    odd = F.lit(False)
    for d in DIMENSIONS:
        odd = odd | F.col(d).isNotNull()
    keys = key_set(components.filter(odd))
    known = key_set(prices)
    return keys.alias("c").join(known.alias("p"), same_key("c", "p", None),
        "left_anti").select(*finding("Error", "UnsupportedModifier", remedy="add prices for these dimensions"))


def observed_prices(components: DataFrame, prices: DataFrame) -> DataFrame:
    """First and last use of every pricing key at each price that it was charged at, whatever the currency; ``charged`` is null
    where no price was in force.  All that an audit asks of usage against prices follows from these few rows."""
    picked = prices.select(*PRICE_KEY, "effective_from", "effective_to", "source", F.lit(True).alias("charged")).alias("p")
    met = components.alias("c").join(picked, same_key("c", "p", None) & in_force("c", "p"), "left")
    return met.groupBy(*(F.col(f"c.{c}") for c in PRICE_KEY), "p.effective_from", "p.effective_to", "p.source", "p.charged").agg(
        F.min("c.timestamp").alias("first_at"), F.max("c.timestamp").alias("last_at"))


def used_sources(components: DataFrame, prices: DataFrame, sources: DataFrame) -> DataFrame:
    """Prices that usage was charged at, whatever their currency, with what is known of their source."""
    used = components.alias("c").join(prices.alias("p"), same_key("c", "p", None) & in_force("c", "p"))
    used = used.select("c.provider", "c.model_id", "c.token_category", "p.effective_from", "p.effective_to", "p.source").distinct()
    return used.join(sources.drop("notes"), "source", "left")


def source_quality(components: DataFrame, prices: DataFrame, sources: DataFrame, today: dt.date) -> DataFrame:
    """Sources without metadata; stale ones and bundled ones that usage relied on."""
    return quality_of_used(used_sources(components, prices, sources), today)


def quality_of_used(used: DataFrame, today: dt.date) -> DataFrame:
    used = used.withColumns({d: F.lit(None).cast("string") for d in DIMENSIONS})
    blank = F.lit(False)
    for c in ("source_url", "source_retrieved_at", "catalog_version", "source_kind"):
        blank = blank | (F.coalesce(c, F.lit("")) == "")
    stale = F.try_to_date("source_retrieved_at", "yyyy-MM-dd") < F.lit(today - dt.timedelta(days=STALE_DAYS))
    kind = lambda s, k: F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"))
    kinds = F.array(F.when(blank, kind("Warning", "MissingSourceMetadata")), F.when(~blank & stale, kind("Warning", "StaleSource")),
        F.when(~blank & (F.col("source_kind") == "bundled"), kind("Info", "BundledFallbackSource")))
    rows = used.select("*", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("f"))
    return rows.select(*finding(F.col("f.s"), F.col("f.k"), text_of(F.col("effective_from")), text_of(F.col("effective_to")),
            "import a reviewed catalog"), "source").withColumn("remediation", F.concat_ws(": ", "source", "remediation")).drop("source")


# -- billing components against usage

def orphans(usage: DataFrame, components: DataFrame) -> DataFrame:
    return components.join(usage.select(*USAGE_KEY), USAGE_KEY, "left_anti")


def duplicates(components: DataFrame) -> DataFrame:
    dims = [F.coalesce(d, F.lit("")).alias(d) for d in DIMENSIONS]
    return components.select(*USAGE_KEY, "token_category", *dims).groupBy(*USAGE_KEY, "token_category",
        *DIMENSIONS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def _actual(components: DataFrame) -> DataFrame:
    return components.groupBy(*USAGE_KEY, "token_category").agg(F.sum("tokens").alias("actual"))


def mismatches(usage: DataFrame, components: DataFrame) -> DataFrame:
    """Categories that should bill but whose components sum to something else."""
    both = expected_components(usage).filter("expected > 0").join(_actual(components), [*USAGE_KEY, "token_category"], "left")
    return both.withColumn("actual", F.coalesce("actual", F.lit(0))).filter("expected != actual")


def unexpected(usage: DataFrame, components: DataFrame) -> DataFrame:
    """Components of requests in the filter whose category should not bill."""
    own = _actual(components).join(usage.select(*USAGE_KEY), USAGE_KEY, "left_semi")
    return own.join(expected_components(usage).filter("expected > 0"), [*USAGE_KEY, "token_category"], "left_anti")


def integrity(usage: DataFrame, components: DataFrame, selected: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """All four checks in order; a filter narrows the last two, the first two are global.

    Usage and components are read once and dealt by request once.  A request's rows lie in order of category and dimensions, its usage
    first, so that sums per request and per category need no further shuffle or sort; a hash leads the order, since ids begin alike.
    Mismatches are found at the usage row, the others at components.
    """
    own = usage if selected is None else selected
    text = lambda c: F.coalesce(c, F.lit(""))
    some = F.lit(False)
    for d in DIMENSIONS:
        some = some | (text(F.col(d)) != "")
    shapes = {"token_category": "string", "_dims": "struct<" + ", ".join(f"{d}: string" for d in DIMENSIONS) + ">", "tokens": "long",
        "_due": "struct<" + ", ".join(f"d{i}: long" for i in range(len(CATEGORIES))) + ">"}

    def rows(df: DataFrame, there: bool, part: bool, **given: Column) -> DataFrame:
        return df.select(F.xxhash64(*USAGE_KEY).alias("_h"), *USAGE_KEY, F.lit(there).alias("_there"), F.lit(part).alias("_part"),
            *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in shapes.items()))

    due = F.struct(*(billable_tokens(c).cast("long").alias(f"d{i}") for i, c in enumerate(CATEGORIES)))
    every = rows(own, selected is None, False, _due=due).unionByName(rows(components, False, True, token_category=F.col("token_category"),
            _dims=F.when(some, F.struct(*(text(F.col(d)).alias(d) for d in DIMENSIONS))), tokens=F.col("tokens")))
    if selected is not None:
        every = every.unionByName(rows(usage, True, False))
    # a key with a null meets no other row
    known, part, tokens = F.col("provider").isNotNull() & F.col("request_id").isNotNull(), F.col("_part"), F.col("tokens")
    owed = [F.col(f"_due.d{i}") for i in range(len(CATEGORIES))]
    bits = [F.when(d > 0, 1 << i).otherwise(0) for i, d in enumerate(owed)]
    request = Window.partitionBy("_h", *USAGE_KEY).orderBy("_part", "token_category", "_dims")
    whole, same = request.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), F.struct("_part", "token_category", "_dims")
    told = every.select("*", F.max(F.col("_there") & known).over(whole).alias("_has_usage"),
        F.bit_or(F.when(known & F.col("_due").isNotNull(), sum(bits[1:], bits[0]))).over(whole).alias("_owes"),
        *(F.sum(F.when(part & known & (F.col("token_category") == c), tokens)).over(whole).alias(f"_a{i}") for i, c in enumerate(CATEGORIES)),
        F.row_number().over(request).alias("_nth"), F.rank().over(request).alias("_rank"), F.lead(same).over(request).alias("_next"))
    # what of a category's components is owed, as a bit
    bit = F.lit(0)
    for i, c in enumerate(CATEGORIES):
        bit = F.when(F.col("token_category") == c, 1 << i).otherwise(bit)
    zero, actual = F.lit(0).cast("long"), [F.coalesce(f"_a{i}", F.lit(0)) for i in range(len(CATEGORIES))]
    orphan = part & ~F.col("_has_usage")
    # the last of equal components tells how many there are
    duplicate = part & (F.col("_nth") > F.col("_rank")) & ~F.col("_next").eqNullSafe(same)
    unexpected = F.coalesce(part & (F.col("_owes").bitwiseAND(bit) == 0), F.lit(False))
    wrong = [~part & (d > 0) & (d != a) for d, a in zip(owed, actual)]

    def found(when: Column, step: int, issue: str, category: Column, expected: Column, actual: Column) -> Column:
        return F.when(when, F.struct(F.lit(step).alias("step"), F.lit(issue).alias("issue"), category.alias("token_category"), expected.alias("expected"),
                actual.cast("long").alias("actual")))

    of = F.col("token_category")
    findings = [found(orphan, 1, "Orphan", of, F.lit(None).cast("long"), tokens),
        found(duplicate, 2, "Duplicate", of, F.lit(1).cast("long"), F.col("_nth") - F.col("_rank") + 1),
        *(found(w, 3, "Mismatch", F.lit(c), d, a) for w, c, d, a in zip(wrong, CATEGORIES, owed, actual)),
        found(unexpected & (F.col("_place") == 1), 4, "Unexpected", of, zero, F.col("_actual"))]
    # few rows are left, among them all of an unexpected category, which are added up here
    left = told.filter(orphan | duplicate | unexpected | F.coalesce(F.greatest(*wrong), F.lit(False)))
    own_category = Window.partitionBy("_h", *USAGE_KEY, "_part", "token_category").orderBy("_dims")
    left = left.select("*", F.row_number().over(own_category).alias("_place"),
        F.sum("tokens").over(own_category.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_actual"))
    out = left.select(*USAGE_KEY, F.explode(F.array(*findings)).alias("f")).filter("f is not null")
    out = out.select("f.step", "f.issue", *USAGE_KEY, "f.token_category", "f.expected", "f.actual")
    return out if limit is None else out.orderBy("step", *USAGE_KEY, "token_category").limit(limit)


def full_audit(
    components: DataFrame, prices: DataFrame, sources: DataFrame, usage: DataFrame, today: dt.date, raw_prices: DataFrame | None = None,
    raw_usage: DataFrame | None = None,
) -> DataFrame:
    """Every finding with the step that made it, in the audit's order: currencies, open intervals, neighbouring intervals,
    billing components, coverage, unknown models, unsupported modifiers, sources.

    Raw price rows, where given, are step -2 and raw usage rows step -1; neither stops the other steps.
    """
    none = [F.lit(None).cast("string").alias(d) for d in DIMENSIONS]
    broken = integrity(usage, components).select("issue", "provider", F.col("request_id").alias("model_id"), "token_category",
        *none).select(*finding("Error", "BillingIntegrity"), "issue").withColumn("remediation", F.col("issue")).drop("issue")
    # a row per pricing key and price stands for all usage in four of the steps
    met = observed_prices(components, prices).cache()
    seen = met.groupBy(*PRICE_KEY).agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    used = met.filter("charged").select("provider", "model_id", "token_category", "effective_from", "effective_to",
        "source").distinct().join(sources.drop("notes"), "source", "left")
    steps = {
        0: currencies(prices), 1: open_intervals(prices), 2: adjacent_pairs(prices), 3: broken, 4: coverage(seen, prices),
        5: unknown_models(seen, prices),
        6: unsupported_modifiers(seen, prices), 7: quality_of_used(used, today),
    }
    if raw_prices is not None:
        steps[-2] = malformed_prices(raw_prices)
    if raw_usage is not None:
        steps[-1] = usage_row_problems(raw_usage)
    out = None
    for i in sorted(steps):
        own = steps[i].withColumn("step", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` numbered in the order of some columns, nulls first; see ``reports.numbered``."""
    return numbered(rows, [F.col(c).asc_nulls_first() for c in columns])


def verdict(findings: DataFrame, provider: str | None = None) -> DataFrame:
    """Findings by severity and whether the audit failed: any error."""
    own = findings if provider is None else findings.filter(F.col("provider") == provider)
    return own.agg(*(F.count_if(F.col("severity") == s).alias(s.lower() + "_count") for s in SEVERITIES),
        F.coalesce(F.bool_or(F.col("severity") == "Error"), F.lit(False)).alias("failed"))
