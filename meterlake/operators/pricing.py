"""Effective-dated prices joined to components, and request costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DIMENSIONS, PROVIDERS, cost_of, normalize_dimension, usd
from ..schemas import PRICE_KEY, TOKEN_COLUMNS, USAGE_KEY
from .components import component_dimensions, component_parts, explode_components


class MissingPricing(ValueError):
    """A cost was asked for where no price applies."""


class OverlappingPricing(ValueError):
    """A cost was asked for where several prices apply."""


def same_key(left: str, right: str, currency: str | None = "USD") -> Column:
    """Equality on provider, model and category, null-safe on the dimensions: all of them hash keys."""
    out = F.lit(True)
    for c in PRICE_KEY:
        a, b = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        out = out & (a.eqNullSafe(b) if c in DIMENSIONS else a == b)
    return out & (F.col(f"{right}.currency") == currency) if currency else out


def in_force(left: str, right: str) -> Column:
    """Half open: from <= timestamp < to, and no end means for ever."""
    t = F.col(f"{left}.timestamp")
    return (F.col(f"{right}.effective_from") <= t) & (F.col(f"{right}.effective_to").isNull() | (t < F.col(f"{right}.effective_to")))


def price_join(rows: DataFrame, prices: DataFrame, how: str = "left") -> DataFrame:
    """Rows with each price that applies; Spark broadcasts the prices where they are small enough."""
    picked = prices.select(*(F.col(c) for c in [*PRICE_KEY, "currency", "rate_per_1m_tokens", "effective_from", "effective_to", "source"]))
    joined = rows.alias("c").join(picked.alias("p"), same_key("c", "p") & in_force("c", "p"), how)
    return joined.select("c.*", F.col("p.rate_per_1m_tokens").alias("rate"), F.col("p.source").alias("price_source"),
        F.col("p.effective_from").alias("price_from"))


def time_bucket(at: Column, days: int) -> Column:
    return F.floor(F.unix_seconds(at) / (days * 86_400))


def price_join_in_time(rows: DataFrame, prices: DataFrame, how: str = "left", days: int = 7, in_time: bool = True) -> DataFrame:
    """``price_join`` for long price histories: intervals are cut at the edges of buckets of ``days`` days, and a row meets only
    the prices of its key and bucket.

    Buckets are part of the hash key, so a busy model's rows are spread over as many of them as they span, and nothing needs to be
    broadcast.  A price has a row for each bucket that it reaches within the span of ``rows``: buckets about as long as the usual price
    lasts keep both sides small.  Without ``in_time`` the times themselves are not compared, which shows what buckets alone
    let through.
    """
    lo, hi = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    picked = prices.select(*PRICE_KEY, "currency", "rate_per_1m_tokens", "effective_from", "effective_to", "source")
    if lo is None:
        return price_join(rows, picked, how)
    lo, hi = (F.lit(x).cast("timestamp") for x in (lo, hi))
    reached = picked.filter((F.col("effective_from") <= hi) & (F.col("effective_to").isNull() | ((F.col("effective_to") > lo) & (F.col("effective_to") > F.col("effective_from")))))
    last = F.least(F.coalesce(F.col("effective_to") - F.expr("interval 1 microsecond"), hi), hi)
    cut = reached.withColumn("_bucket", F.explode(F.sequence(time_bucket(F.greatest("effective_from", lo), days), time_bucket(last, days))))
    meets = same_key("c", "p") & (F.col("c._bucket") == F.col("p._bucket"))
    if in_time:
        meets = meets & in_force("c", "p")
    joined = rows.withColumn("_bucket", time_bucket(F.col("timestamp"), days)).alias("c").join(cut.alias("p"), meets, how)
    return joined.select(*(F.col(f"c.{c}") for c in rows.columns), F.col("p.rate_per_1m_tokens").alias("rate"), F.col("p.source").alias("price_source"),
        F.col("p.effective_from").alias("price_from"))


def price_sums_in_time(rows: DataFrame, prices: DataFrame, days: int = 7) -> DataFrame:
    """Rows with how many prices apply (``matches``), how many of these have a rate (``rates``) and the sum of their rates
    (``rate_sum``, null where there is none): what sums over ``price_join`` need, without a row for each pair.

    A price counts from its start and stops at its end, so what is in force is a running sum over the edges of its key, exact in
    decimals.  Edges of one instant are added up first, time is cut into buckets of ``days`` days, and what was in force before a
    bucket is a running sum over a row per key and bucket: the work grows with rows and prices and not with their
    pairs, and no task holds more of a key than a bucket.
    """
    rate = F.col("rate_per_1m_tokens").cast("decimal(18,6)")
    own = prices.filter("currency = 'USD' and provider is not null and model_id is not null and token_category is not null and effective_from is not null "
        "and (effective_to is null or effective_to > effective_from)")
    edge = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("sign"))
    edges = own.select(*PRICE_KEY, rate.alias("rate"), F.inline(F.array(edge("effective_from", 1), edge("effective_to", -1)))).filter("at is not null")
    changes = {"_n": F.sum("sign").cast("long"), "_m": F.sum(F.when(F.col("rate").isNotNull(), F.col("sign")).otherwise(0)).cast("long"),
        "_r": F.coalesce(F.sum(F.col("sign") * F.col("rate")), F.lit(0)).cast("decimal(28,6)")}
    at = edges.groupBy(*PRICE_KEY, "at").agg(*(c.alias(n) for n, c in changes.items())).withColumn("_bucket", time_bucket(F.col("at"), days))
    sums = [F.sum(c).alias(c) for c in changes]
    zero = [F.lit(0).cast("decimal(28,6)" if c == "_r" else "long").alias(c) for c in changes]
    asked = rows.select(*PRICE_KEY, time_bucket(F.col("timestamp"), days).alias("_bucket")).distinct().select(*PRICE_KEY, "_bucket", *zero)
    each = at.select(*PRICE_KEY, "_bucket", *changes).unionByName(asked).groupBy(*PRICE_KEY, "_bucket").agg(*sums)
    past = Window.partitionBy(*PRICE_KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(None).cast(rows.schema)
    total = lambda w: {c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("decimal(28,6)" if c == "_r" else "long") for c in changes}
    # what was in force before comes first, then changes, and rows of an instant after its changes
    before = each.select(*PRICE_KEY, "_bucket", *(x.alias(c) for c, x in total(past).items()), F.lit(0).alias("_turn"), F.lit(None).cast("timestamp").alias("_at"),
        none.alias("_row"))
    within = at.select(*PRICE_KEY, "_bucket", *changes, F.lit(1).alias("_turn"), F.col("at").alias("_at"), none.alias("_row"))
    told = rows.select(*PRICE_KEY, time_bucket(F.col("timestamp"), days).alias("_bucket"), *zero, F.lit(2).alias("_turn"), F.col("timestamp").alias("_at"),
        F.struct(*rows.columns).alias("_row"))
    so_far = Window.partitionBy(*PRICE_KEY, "_bucket").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    running = before.unionByName(within).unionByName(told).select("_turn", "_row", *(x.alias(c) for c, x in total(so_far).items()))
    return running.filter("_turn = 2").select("_row.*", F.col("_n").alias("matches"), F.col("_m").alias("rates"),
        F.when(F.col("_m") > 0, F.col("_r")).alias("rate_sum"))


def component_costs(components: DataFrame, prices: DataFrame) -> DataFrame:
    """Per component: how many prices match, and its exact cost where exactly one does.

    Dealt by request once: the sums per component, those per request and the join with usage all use that layout.
    """
    key = [*USAGE_KEY, "component_ordinal"]
    matched = price_join(components, prices).repartition(*USAGE_KEY)
    n = F.count("rate")
    return matched.groupBy(*key).agg(n.alias("price_matches"), F.when(n == 1, F.sum(cost_of("tokens", "rate"))).alias("exact"))


def why(status: Column) -> Column:
    return (
        F.when(status == "ambiguous", "a component has several prices at its time")
        .when(status == "integrity", "tokens are billable but no component bills them")
        .when(status == "missing", "a component has no price at its time").otherwise("")
    )


def timelines(prices: DataFrame) -> DataFrame:
    """Per model and dimensions the stretches of time in which its prices stay the same, one row each: which parts of a
    request have no price and which have several, as bits, and the rates of those with one (r0, r1, ... in the order of
    ``component_parts``, 0 elsewhere).

    A price opens at its start and closes at its end; numbers and rates in force are running sums of what opened less what
    closed, which are exact in decimals, so the work grows with the changes of a model and not with their square.
    """
    shared = [c for c in PRICE_KEY if c not in ("token_category", "source_detail")]
    rate = F.col("rate_per_1m_tokens").cast("decimal(18,6)")
    own = prices.filter("currency = 'USD' and effective_from is not null and (effective_to is null or effective_to > effective_from)")
    edge = lambda at, sign: F.struct(F.col(at).alias("since"), F.lit(sign).alias("sign"))
    edges = own.select(*PRICE_KEY, rate.alias("rate"), F.inline(F.array(edge("effective_from", 1), edge("effective_to", -1)))).filter("since is not null")
    parts = component_parts()
    changes = []
    for i, (category, detail, _) in enumerate(parts):
        same = (F.col("token_category") == category) & F.col("source_detail").eqNullSafe(F.lit(detail).cast("string"))
        changes += [F.sum(F.when(same, F.col("sign")).otherwise(0)).alias(f"n{i}"),
            F.sum(F.when(same, F.col("sign") * F.col("rate")).otherwise(0)).cast("decimal(28,6)").alias(f"r{i}")]
    # dealt by model once: sums per edge and running sums use the same layout
    at = edges.repartition(*shared).groupBy(*shared, "since").agg(*changes)
    past = Window.partitionBy(*shared).orderBy("since")
    so_far = past.rowsBetween(Window.unboundedPreceding, 0)
    running = at.select(*shared, "since", F.lead("since").over(past).alias("until"), *(F.sum(f"{c}{i}").over(so_far).alias(f"{c}{i}") for i in range(len(parts)) for c in "nr"))
    n = [F.col(f"n{i}") for i in range(len(parts))]
    rates = [F.when(c == 1, F.col(f"r{i}").cast("decimal(18,6)")).otherwise(F.lit(0).cast("decimal(18,6)")).alias(f"r{i}") for i, c in enumerate(n)]
    none, several = (_bits([test(c) for c in n]) for test in (lambda c: c == 0, lambda c: c > 1))
    return running.filter(F.greatest(*n) > 0).select(*shared, "since", "until", none.alias("none"), several.alias("several"), *rates)


def _bits(tests: list[Column]) -> Column:
    """One number with a bit for each test that holds."""
    bits = [F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)]
    return sum(bits[1:], bits[0])


def priced_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with ``exact`` and ``status``, as ``request_costs`` finds them for the components that usage gives rise to.

    A request's components share everything but category and detail, so one join per request with the stretch of time that
    holds it prices them all: usage is read once, nothing is exploded, and with timelines that Spark broadcasts nothing is
    shuffled.
    """
    dims = {f"_{d}": c for d, c in component_dimensions().items()}
    t = F.col("u.timestamp")
    meets = (F.col("u.provider") == F.col("o.provider")) & (F.col("u.model_id") == F.col("o.model_id"))
    for d in dims:
        meets = meets & F.col(f"u.{d}").eqNullSafe(F.col(f"o.{d[1:]}"))
    meets = meets & (F.col("o.since") <= t) & (F.col("o.until").isNull() | (t < F.col("o.until")))
    # tokens and bits are worked out before the join, and what a request bills meets its prices as bits: each piece of
    # generated code stays short enough to be compiled
    tokens = {f"_t{i}": F.greatest(t, F.lit(0).cast("long")) for i, (_, _, t) in enumerate(component_parts())}
    bits = {"_billed": _bits([t > 0 for t in tokens.values()])}
    found = ["o.none", "o.several", *(f"o.r{i}" for i in range(len(tokens)))]
    joined = usage.withColumns(dims | tokens | bits).alias("u").join(timelines(prices).alias("o"), meets, "left").select("u.*", *found)
    total = lambda columns: sum(columns[1:], columns[0])
    billed, every = F.col("_billed"), F.lit((1 << len(tokens)) - 1)
    several = billed.bitwiseAND(F.coalesce("several", F.lit(0))) > 0
    missing = billed.bitwiseAND(F.coalesce("none", every)) > 0
    integrity = (billed == 0) & (total([F.col(c) for c in TOKEN_COLUMNS]) > 0)
    status = F.when(several, "ambiguous").when(integrity, "integrity").when(missing, "missing").otherwise("priced")
    costs = [cost_of(t, f"r{i}").cast("decimal(38,6)") for i, t in enumerate(tokens)]
    exact = F.when(F.col("status") == "priced", F.coalesce(total(costs), F.lit(0)).cast("decimal(38,6)"))
    return joined.withColumn("status", status).select(*usage.columns, exact.alias("exact"), "status")


def request_costs(usage: DataFrame, components: DataFrame, prices: DataFrame, generation: int = 1) -> DataFrame:
    """One row per request: cost, status (ambiguous, integrity, missing, priced, in that order) and why."""
    per = component_costs(components, prices).groupBy(*USAGE_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("price_matches") == 1).alias("priced"),
        F.count_if(F.col("price_matches") > 1).alias("ambiguous"), F.sum("exact").alias("exact"),
    )
    tokens = sum((F.col(c) for c in TOKEN_COLUMNS[1:]), F.col(TOKEN_COLUMNS[0]))
    status = (
        F.when(F.coalesce("ambiguous", F.lit(0)) > 0, "ambiguous")
        .when(F.col("n").isNull() & (tokens > 0), "integrity")
        .when(F.coalesce("priced", F.lit(0)) < F.coalesce("n", F.lit(0)), "missing").otherwise("priced")
    )
    said = why(F.col("status"))
    exact = F.when(F.col("status") == "priced", F.coalesce("exact", F.lit(0).cast("decimal(38,6)")))
    return (
        usage.join(per, USAGE_KEY, "left").withColumn("status", status)
        .select(*USAGE_KEY, exact.alias("exact"), "status", F.lit(generation).alias("pricing_generation"), said.alias("detail"))
    )


def usage_costs(usage: DataFrame, prices: DataFrame, generation: int = 1) -> DataFrame:
    """``request_costs`` for the components that usage gives rise to: each request is priced where it is read, so that no task
    holds the components of others."""
    return priced_usage(usage, prices).select(*USAGE_KEY, "exact", "status", F.lit(generation).alias("pricing_generation"), why(F.col("status")).alias("detail"))


def with_usd(costs: DataFrame) -> DataFrame:
    return costs.withColumn("cost_usd", usd("exact")).drop("exact")


def lookup(points: DataFrame, prices: DataFrame) -> DataFrame:
    """Price at points (key, timestamp): normalised dimensions, matches, and the rate where exactly one applies."""
    normal = points.withColumns({d: normalize_dimension("provider", d, d) for d in DIMENSIONS[:3]})
    n = F.count("rate")
    return price_join(normal, prices).groupBy(*PRICE_KEY, "timestamp").agg(
        n.alias("price_matches"), F.when(n == 1, F.max("rate")).alias("rate"),
        F.when(n == 0, "missing").when(n > 1, "overlapping").otherwise("found").alias("result"),
    )


def observed_coverage(components: DataFrame, prices: DataFrame) -> DataFrame:
    """Observed (key, timestamp) points without exactly one price; gaps nobody used are fine."""
    points = components.select(*PRICE_KEY, "timestamp").distinct()
    found = price_join(points, prices).groupBy(*PRICE_KEY, "timestamp").agg(F.count("rate").alias("price_matches"))
    return found.filter("price_matches != 1").withColumn("problem", F.when(F.col("price_matches") == 0, "missing").otherwise("overlap"))


def unpriced(usage: DataFrame, costs: DataFrame, generations: DataFrame) -> DataFrame:
    """Requests whose cost is absent, not priced, or of an older price generation."""
    state = generations.select("provider", F.col("generation").alias("now"))
    stale = F.col("status").isNull() | (F.col("status") != "priced") | (F.col("pricing_generation") != F.col("now"))
    return usage.join(costs, USAGE_KEY, "left").join(state, "provider").filter(stale).select(*USAGE_KEY, "model_id", "timestamp",
        F.coalesce("status", F.lit("absent")).alias("status"))


def require_cost(usage: DataFrame, costs: DataFrame, generations: DataFrame, components: DataFrame, prices: DataFrame) -> None:
    """Fail loudly if any filtered request has no certain cost; looks at one bad row at most."""
    bad = unpriced(usage, costs, generations).limit(1).collect()
    if not bad:
        return
    point = observed_coverage(components.join(usage.select(*USAGE_KEY), USAGE_KEY, "left_semi"), prices).limit(1).collect()
    if not point:
        raise MissingPricing(f"cost of {bad[0]['provider']}/{bad[0]['request_id']} is {bad[0]['status']}")
    p = point[0]
    kind = MissingPricing if p["price_matches"] == 0 else OverlappingPricing
    raise kind(f"{p['problem']} price: {p['provider']}/{p['model_id']}/{p['token_category']} at {p['timestamp']}")


def require_priced(rows: DataFrame, prices: DataFrame) -> None:
    """``require_cost`` for the rows of ``priced_usage``: looks at one bad row at most, and then at its components."""
    bad = rows.filter("status != 'priced'").limit(1).collect()
    if not bad:
        return
    own = rows.filter((F.col("provider") == bad[0]["provider"]) & (F.col("request_id") == bad[0]["request_id"]))
    point = observed_coverage(explode_components(own), prices).limit(1).collect()
    said = f"{bad[0]['provider']}/{bad[0]['request_id']} is {bad[0]['status']}"
    if point:
        said += f": {point[0]['problem']} price of {point[0]['model_id']}/{point[0]['token_category']} at {point[0]['timestamp']}"
    raise (OverlappingPricing if bad[0]["status"] == "ambiguous" else MissingPricing)(f"cost of {said}")


def record_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of every request, null where any of its components lacks exactly one price."""
    return with_usd(priced_usage(usage, prices).select(*USAGE_KEY, "exact"))


def record_cost(usage: DataFrame, components: DataFrame, prices: DataFrame, provider: str, request_id: str) -> float:
    """Cost of one request; raises where any of its components lacks exactly one price."""
    own = (F.col("provider") == provider) & (F.col("request_id") == request_id)
    row = with_usd(request_costs(usage.filter(own), components.filter(own), prices)).first()
    if row is None or row["status"] != "priced":
        raise MissingPricing(f"{provider}/{request_id}: {'no such request' if row is None else row['detail']}")
    return row["cost_usd"]


def reprice(costs: DataFrame, fresh: DataFrame, providers: tuple[str, ...] = PROVIDERS) -> DataFrame:
    """Costs with the rows of the given providers replaced by fresh ones."""
    gone = fresh.sparkSession.createDataFrame([(p,) for p in providers], "provider string")
    return costs.join(F.broadcast(gone), "provider", "left_anti").unionByName(fresh.join(F.broadcast(gone), "provider", "left_semi"))
