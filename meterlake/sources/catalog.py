"""Price catalogs: reading, validating, expanding, and refreshing effective-dated prices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import CATEGORIES, DIMENSIONS
from ..schemas import PRICE_COLUMNS, PRICE_KEY, PRICES

CATALOG = (
    "schema_version int, notes string, first_position long, sources array<struct<id:string,url:string,retrieved_at:string,notes:string>>, "
    "entries array<struct<provider:string,model_ids:array<string>,model_aliases:array<string>,currency:string,effective_from:string,effective_to:string,"
    "source:string,source_ref:string,dimensions:struct<service_tier:string,speed:string,region:string,processing_mode:string,source_detail:string>,"
    "rates_per_1m_tokens:map<string,decimal(18,6)>,notes:string>>"
)
KINDS = ("bundled", "reviewed", "manual")


class CatalogError(ValueError):
    """A catalog or price table that breaks its rules."""


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON document, a document a file.

    A long catalog comes in several documents, since one is a single row and thus a single task's: each has a part of the entries
    and says in ``first_position`` where in the whole it begins; sources may be told by any of them."""
    return spark.read.schema(CATALOG).json(path, multiLine=True)


def catalog_entries(catalog: DataFrame) -> DataFrame:
    first = F.coalesce("first_position", F.lit(0).cast("long")) if "first_position" in catalog.columns else F.lit(0).cast("long")
    return catalog.select(first.alias("_first"), F.posexplode("entries").alias("_pos", "e")).select((F.col("_first") + F.col("_pos")).alias("position"), "e.*")


def catalog_prices(catalog: DataFrame) -> DataFrame:
    """Every entry for each of its models and each of its rates."""
    instant = lambda c: F.coalesce(F.try_to_timestamp(c), F.try_to_date(c, "yyyy-MM-dd").cast("timestamp"))
    rows = catalog_entries(catalog).withColumn("model_id", F.explode("model_ids"))
    return rows.select("*", F.explode("rates_per_1m_tokens").alias("token_category", "rate_per_1m_tokens")).select(
        "provider", "model_id", "token_category", *(F.col(f"dimensions.{d}").alias(d) for d in DIMENSIONS), "currency",
        F.col("rate_per_1m_tokens").cast("decimal(18,6)").alias("rate_per_1m_tokens"), instant(F.col("effective_from")).alias("effective_from"),
        instant(F.col("effective_to")).alias("effective_to"), "source",
    )


def catalog_sources(catalog: DataFrame, kind: str = "reviewed") -> DataFrame:
    """Metadata per source label: its first entry wins, the notes of source and entry are joined."""
    refs = catalog.select("schema_version", F.explode("sources").alias("s")).select("schema_version", F.col("s.id").alias("source_ref"),
        F.col("s.url").alias("url"), F.col("s.retrieved_at").alias("at"), F.col("s.notes").alias("source_notes"))
    # the first entry by an aggregate, which tasks begin on their own: a source may have most of all entries
    entries = catalog_entries(catalog).groupBy("source").agg(F.min(F.struct("position", "source_ref", "notes")).alias("e")).select("source", "e.source_ref",
        F.col("e.notes").alias("entry_notes"))
    return entries.join(refs, "source_ref").select(
        "source", F.col("url").alias("source_url"), F.col("at").alias("source_retrieved_at"),
        F.col("schema_version").cast("string").alias("catalog_version"),
        F.lit(kind).alias("source_kind"), F.concat_ws("; ", F.nullif("source_notes", F.lit("")), F.nullif("entry_notes", F.lit(""))).alias("notes"),
    )


def _blank(c):
    return F.coalesce(F.trim(c), F.lit("")) == ""


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """(problem, subject) of everything a catalog may not have."""
    sources = catalog.select(F.explode("sources").alias("s")).select("s.*")
    entries = catalog_entries(catalog)
    say = lambda df, when, what, who: df.filter(when).select(F.lit(what).alias("problem"), who.cast("string").alias("subject"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    sizes = catalog.agg(*(F.sum(size(c)).alias(c) for c in ("sources", "entries"))).filter("entries is not null")
    keys = catalog_prices(catalog).groupBy(*PRICE_KEY, "currency", "effective_from").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        say(catalog.select("schema_version").distinct(), F.coalesce(F.col("schema_version"), F.lit(0)) != 1, "unsupported version", F.col("schema_version")),
        say(sizes, F.col("sources") == 0, "no sources", F.lit("catalog")), say(sizes, F.col("entries") == 0, "no entries", F.lit("catalog")),
        say(sources.groupBy("id").count(), F.col("count") > 1, "repeated source id", F.col("id")),
        say(sources, _blank(F.col("id")), "blank source id", F.col("url")),
        say(sources, ~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "source url is not https", F.col("id")),
        say(sources, F.try_to_date("retrieved_at", "yyyy-MM-dd").isNull(), "bad retrieval date", F.col("id")),
        say(entries, (size("model_ids") == 0) | F.exists("model_ids", _blank), "no or blank model ids", F.col("position")),
        say(entries, size("rates_per_1m_tokens") == 0, "no rates", F.col("position")),
        say(entries, _blank(F.col("source")), "blank source", F.col("position")),
        say(entries.join(sources.select(F.col("id").alias("source_ref")).distinct(), "source_ref", "left_anti"), F.lit(True), "unknown source_ref",
            F.col("position")),
        say(keys, F.col("n") > 1, "repeated price", F.concat_ws("/", "provider", "model_id", "token_category")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def interval_violations(prices: DataFrame) -> DataFrame:
    c = F.col
    checks = [
        F.when(c("currency") != "USD", "currency is not USD"), F.when(c("rate_per_1m_tokens") < 0, "rate is negative"),
        F.when(c("rate_per_1m_tokens").isNull(), "rate is missing"),
        F.when(c("effective_from").isNull(), "no effective_from"), F.when(c("effective_to") <= c("effective_from"), "ends before it begins"),
        F.when(~c("token_category").isin(*CATEGORIES), "unsupported category"),
        *(F.when(c(d).isNotNull() & _blank(c(d)), f"blank {d}") for d in DIMENSIONS),
    ]
    return prices.select("*", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))


def source_violations(sources: DataFrame) -> DataFrame:
    checks = [
        *(F.when(_blank(F.col(x)), f"blank {x}") for x in ("source", "source_url", "source_retrieved_at", "catalog_version", "source_kind")),
        F.when(~F.col("source_kind").isin(*KINDS), "unknown kind"),
        F.when(~_blank(F.col("source_retrieved_at")) & F.try_to_date("source_retrieved_at", "yyyy-MM-dd").isNull(), "bad retrieval date"),
    ]
    return sources.select("source", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))


def require_none(violations: DataFrame, what: str) -> None:
    bad = violations.limit(1).collect()
    if bad:
        raise CatalogError(f"{what}: {bad[0].asDict()}")


def import_catalog(spark: SparkSession, path: str, prices: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A reviewed catalog, validated and folded into the stored prices and sources."""
    catalog = read_catalog(spark, path)
    require_none(catalog_violations(catalog), "catalog")
    fresh, meta = catalog_prices(catalog), catalog_sources(catalog)
    require_none(interval_violations(fresh), "prices")
    require_none(source_violations(meta), "sources")
    return refresh(prices, fresh), upsert_sources(sources, meta)


def upsert_sources(sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """The last write per source wins."""
    both = sources.withColumn("_w", F.lit(0)).unionByName(fresh.withColumn("_w", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("_w")))
    return both.withColumn("_r", last).filter("_r = 1").drop("_w", "_r")


def same_price(left: str, right: str, *more: str):
    out = F.lit(True)
    for c in [*PRICE_KEY, *more]:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def seed_rows(prices: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows whose key, currency and start are not stored yet."""
    return fresh.alias("f").join(prices.alias("p"), same_price("f", "p", "currency", "effective_from"), "left_anti")


def seed(prices: DataFrame, fresh: DataFrame) -> DataFrame:
    return prices.unionByName(seed_rows(prices, fresh))


def refresh_plan(prices: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each snapshot row with what it does to its key's open row, and how many rows that changes."""
    opened = prices.filter("effective_to is null").groupBy(*PRICE_KEY).agg(F.count(F.lit(1)).alias("opens"),
        F.max(F.struct("effective_from", "rate_per_1m_tokens", "source")).alias("o"))
    rows = snapshot.alias("s").join(opened.alias("p"), same_price("s", "p"), "left").select("s.*", "p.opens", "p.o")
    same_rate, start, old = F.col("rate_per_1m_tokens") == F.col("o.rate_per_1m_tokens"), F.col("effective_from"), F.col("o.effective_from")
    action = (
        F.when(F.col("opens").isNull(), "insert").when(F.col("opens") > 1, "ambiguous").when(same_rate & (F.col("source") == F.col("o.source")),
            "keep").when(same_rate, "relabel")
        .when(start > old, "close").when(start == old, "replace").otherwise("stale")
    )
    count = F.when(F.col("action") == "close", 2).when(F.col("action").isin("insert", "relabel", "replace"), 1).otherwise(0)
    return rows.withColumn("action", action).withColumn("changes", count).drop("o", "opens")


#: What a price is besides its key.
_ROW = ["currency", "rate_per_1m_tokens", "effective_from", "effective_to", "source"]
_ROW_TYPE = "struct<currency:string,rate_per_1m_tokens:decimal(18,6),effective_from:timestamp,effective_to:timestamp,source:string>"


def _row(x: Column, **changed: Column) -> Column:
    return F.struct(*(changed.get(c, x[c]).alias(c) for c in _ROW))


def fold(prices: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(price key, rows, problem): of each key in a snapshot the rows that its open price and its snapshot rows, one after the other by
    ``position``, leave behind; ``problem`` is null where that went well.

    A row with the open one's rate gives it its source; a later one closes it and follows it; one that begins with it takes its
    place; an earlier one is ``stale``; several open prices are ``ambiguous``.  A row that has an end follows, but is not open.
    """
    opened = prices.filter("effective_to is null").groupBy(*PRICE_KEY).agg(F.count(F.lit(1)).alias("_opens"), F.first(F.struct(*_ROW)).alias("_open"))
    fresh = snapshot.groupBy(*PRICE_KEY).agg(F.array_sort(F.collect_list(F.struct("position", *_ROW))).alias("_fresh"))
    both = fresh.alias("s").join(opened.alias("p"), same_price("s", "p"), "left").select("s.*", "p._opens", "p._open")
    kind, kinds = _ROW_TYPE, f"array<{_ROW_TYPE}>"
    none, row = F.lit(None).cast(kind), F.col("_open").cast(kind)
    state = lambda now, past, problem: F.struct(now.cast(kind).alias("now"), past.cast(kinds).alias("past"), problem.cast("string").alias("problem"))
    begin = state(row, F.array(), F.when(F.col("_opens") > 1, "ambiguous"))

    def follow(past: Column, x: Column) -> Column:
        """A row that comes next: open, or closed at once."""
        new = _row(x)
        return F.when(x["effective_to"].isNull(), state(new, past, F.lit(None))).otherwise(state(none, F.concat(past, F.array(new.cast(kind))), F.lit(None)))

    def step(acc: Column, x: Column) -> Column:
        now, past = acc["now"], acc["past"]
        closed = _row(now, effective_to=x["effective_from"]).cast(kind)
        instead = _row(now, rate_per_1m_tokens=x["rate_per_1m_tokens"], source=x["source"], effective_to=x["effective_to"])
        return (
            F.when(acc["problem"].isNotNull(), acc)
            .when(now.isNull(), follow(past, x))
            .when(now["rate_per_1m_tokens"] == x["rate_per_1m_tokens"], state(_row(now, source=x["source"]), past, F.lit(None)))
            .when(x["effective_from"] > now["effective_from"], follow(F.concat(past, F.array(closed)), x))
            .when(x["effective_from"] == now["effective_from"], follow(past, instead))
            .otherwise(state(now, past, F.lit("stale")))
        )

    done = both.withColumn("_done", F.aggregate("_fresh", begin, step))
    rows = F.concat("_done.past", F.when(F.col("_done.now").isNotNull(), F.array(F.col("_done.now"))).otherwise(F.array().cast(kinds)))
    return done.select(*PRICE_KEY, rows.alias("rows"), F.col("_done.problem").alias("problem"))


def refresh(prices: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Prices after a snapshot; raises, and changes nothing, where a row is older than what is in force or ambiguous.

    Keys with one snapshot row are settled by joins.  Keys with several see each other's effect in snapshot
    order: a fold over the ordered rows of each such key.
    """
    if "position" not in snapshot.columns:
        snapshot = snapshot.withColumn("position", F.monotonically_increasing_id())
    # columns of their own, also where both sides come from one table
    snapshot = snapshot.select(*(F.col(c).alias(c) for c in snapshot.columns))
    n = snapshot.groupBy(*PRICE_KEY).agg(F.count(F.lit(1)).alias("n"))
    several = n.filter("n > 1").drop("n")
    once = snapshot.alias("s").join(several.alias("k"), same_price("s", "k"), "left_anti")
    plan = refresh_plan(prices, once)
    require_none(plan.filter("action in ('stale', 'ambiguous')"), "refresh")
    todo = plan.select(*PRICE_KEY, F.col("effective_from").alias("n_from"), F.col("effective_to").alias("n_to"),
        F.col("rate_per_1m_tokens").alias("n_rate"), F.col("source").alias("n_source"), "action")
    rest = prices.alias("p").join(several.alias("k"), same_price("p", "k"), "left_anti")
    is_open = F.col("p.effective_to").isNull()
    joined = rest.alias("p").join(todo.alias("t"), same_price("p", "t") & is_open, "left")
    at = lambda action, new, old: F.when(F.col("t.action").isin(*action), new).otherwise(old)
    changed = joined.select(
        *(F.col(f"p.{c}").alias(c) for c in [*PRICE_KEY, "currency"]),
        at(["replace"], F.col("t.n_rate"), F.col("p.rate_per_1m_tokens")).alias("rate_per_1m_tokens"),
        F.col("p.effective_from").alias("effective_from"),
        F.when(F.col("t.action") == "close", F.col("t.n_from")).when(F.col("t.action") == "replace",
            F.col("t.n_to")).otherwise(F.col("p.effective_to")).alias("effective_to"),
        at(["replace", "relabel"], F.col("t.n_source"), F.col("p.source")).alias("source"),
    )
    out = changed.select(*PRICE_COLUMNS).unionByName(plan.filter("action in ('insert', 'close')").select(*PRICE_COLUMNS))
    left = prices.alias("p").join(several.alias("k"), same_price("p", "k"), "left_semi").select(*PRICE_COLUMNS)
    right = snapshot.alias("s").join(several.alias("k"), same_price("s", "k"), "left_semi").select(*PRICE_COLUMNS, "position")
    folded = fold(left, right)
    require_none(folded.filter("problem is not null").select(*PRICE_KEY, F.col("problem").alias("action")), "refresh")
    after = folded.select(*PRICE_KEY, F.explode("rows").alias("r")).select(*PRICE_KEY, "r.*").select(*PRICE_COLUMNS)
    return out.unionByName(left.filter("effective_to is not null")).unionByName(after)


def back_date(fresh: DataFrame, prices: DataFrame, components: DataFrame) -> DataFrame:
    """Prices of keys that are not stored yet begin at the earliest observed use, if that is earlier."""
    first = components.groupBy(*PRICE_KEY).agg(F.min("timestamp").alias("first_at"))
    stored = prices.select(*PRICE_KEY).distinct().withColumn("stored", F.lit(True))
    rows = fresh.alias("f").join(stored.alias("s"), same_price("f", "s"), "left").select("f.*", "s.stored")
    rows = rows.alias("f").join(first.alias("u"), same_price("f", "u"), "left").select("f.*", "u.first_at")
    start = F.when(F.col("stored").isNull(), F.least("effective_from", "first_at")).otherwise(F.col("effective_from"))
    return rows.withColumn("effective_from", start).drop("stored", "first_at")


#: Fixed value: what a regional copy of a price costs of the plain one.
REGIONAL = "1.1"


def expand_rates(rates: DataFrame, effective_from: dt.datetime, source: str) -> DataFrame:
    """A wide row of rates per model to its intervals.

    The first provider's cache creation costs the five-minute rate where the lifetime is unknown, and has a row
    per lifetime; eligible models get regional copies.  The other provider's rows carry the standard mode, and its
    reasoning costs what output does.
    """
    claude, codex = F.col("provider") == "claude-code", F.col("provider") == "codex"
    none = F.lit(None).cast("string")
    part = lambda when, cat, rate, detail=none: F.when(when & rate.isNotNull(),
        F.struct(F.lit(cat).alias("token_category"), rate.cast("decimal(18,6)").alias("rate"), detail.alias("source_detail")))
    c = F.col
    parts = F.array(
        part(F.lit(True), "input", c("input")), part(F.lit(True), "output", c("output")), part(claude, "cache_read", c("cache_read")),
        part(claude, "cache_creation", c("cache_5m")),
        part(claude, "cache_creation", c("cache_5m"), F.lit("ephemeral_5m")), part(claude, "cache_creation", c("cache_1h"), F.lit("ephemeral_1h")),
        part(codex, "cached_input", c("cache_read")), part(codex, "reasoning_output", c("output")),
    )
    rows = rates.select("provider", "model_id", "regional", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"))
    rows = rows.withColumn("region", F.explode(F.when(claude & c("regional"), F.array(none, F.lit("us"))).otherwise(F.array(none))))
    rate = F.when(c("region") == "us", (c("p.rate") * F.lit(REGIONAL).cast("decimal(3,1)")).cast("decimal(18,6)")).otherwise(c("p.rate"))
    return rows.select(
        "provider", "model_id", "p.token_category", none.alias("service_tier"), none.alias("speed"), "region",
        F.when(codex, "standard").alias("processing_mode"), "p.source_detail",
        F.lit("USD").alias("currency"), rate.alias("rate_per_1m_tokens"), F.lit(effective_from).cast("timestamp").alias("effective_from"),
        F.lit(None).cast("timestamp").alias("effective_to"), F.lit(source).alias("source"),
    )
