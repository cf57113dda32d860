"""Prices joined in time, stored costs, and streams that tell each window once."""

import datetime as dt
import decimal
import glob
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterlake import streaming
from meterlake.operators import components, pricing, stored_costs
from meterlake.plans.queries import QUERIES
from meterlake.schemas import PRICE_KEY, PRICES
from meterlake.sources import bridge, catalog

SF = "/root/testdata/sf0.001"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def history(spark, n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.randint(0, 300)
        end = rng.choice([None, day(start), day(start + rng.randint(0, 60)), day(start - 1)])
        rows.append(("p", rng.choice("ab"), "input", None, None, rng.choice([None, "us"]), None, None, rng.choice(["USD", "USD", "EUR"]), None, day(start), end, "s"))
    return spark.createDataFrame(rows, PRICES).withColumn("rate_per_1m_tokens", F.lit("1.5").cast("decimal(18,6)"))


def points(spark, n=500, seed=1):
    rng = random.Random(seed)
    rows = [("p", rng.choice("ab"), "input", None, None, rng.choice([None, "us"]), None, None, day(rng.randint(-5, 320), rng.randint(0, 23)), i) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in PRICE_KEY) + ", timestamp timestamp, i long")


def test_buckets_change_nothing(spark):
    rows, prices = points(spark), history(spark)
    for how in ("left", "inner"):
        want = Counter(map(str, pricing.price_join(rows, prices, how).collect()))
        for days in (1, 14, 5000):
            assert Counter(map(str, pricing.price_join_in_time(rows, prices, how, days).collect())) == want
    assert pricing.price_join_in_time(rows.limit(0), prices).count() == 0
    assert pricing.price_join_in_time(rows, prices.limit(0)).filter("rate is null").count() == 500


def test_sums_in_time_are_those_of_the_join(spark):
    prices = history(spark).withColumn("rate_per_1m_tokens", F.when(F.dayofmonth("effective_from") % 5 > 0, F.dayofmonth("effective_from")).cast("decimal(18,6)"))
    odd = points(spark, 4, 7).withColumns({"timestamp": F.when(F.col("i") > 1, F.col("timestamp")), "model_id": F.when(F.col("i") != 2, F.col("model_id")), "i": F.col("i") + 500})
    rows = points(spark).unionByName(odd)
    of_row = pricing.price_join(rows, prices.withColumn("source", F.lit("s"))).groupBy("i").agg(F.count("price_source").alias("matches"), F.count("rate").alias("rates"),
        F.sum("rate").cast("decimal(28,6)").alias("rate_sum"))
    want = {tuple(r) for r in of_row.collect()}
    assert len(want) == 504 and max(w[1] for w in want) > 5
    for days in (1, 14, 5000):
        assert {tuple(r) for r in pricing.price_sums_in_time(rows, prices, days).select("i", "matches", "rates", "rate_sum").collect()} == want
    assert pricing.price_sums_in_time(rows.limit(0), prices).count() == 0
    assert pricing.price_sums_in_time(rows, prices.limit(0)).filter("matches = 0 and rate_sum is null").count() == 504


def test_sums_in_time_make_no_pairs(spark):
    """20,000 rows under 20,000 prices of one key are 400 million pairs; the sums take a row each."""
    key = [F.lit("p").alias("provider"), F.lit("m").alias("model_id"), F.lit("input").alias("token_category"), *(F.lit(None).cast("string").alias(c) for c in PRICE_KEY[3:])]
    rows = spark.range(20_000).select(*key, F.lit(day(30)).alias("timestamp"), F.col("id").alias("i"))
    prices = spark.range(20_000).select(*key, F.lit("USD").alias("currency"), F.lit("2").cast("decimal(18,6)").alias("rate_per_1m_tokens"), F.lit(day(0)).alias("effective_from"),
        F.lit(None).cast("timestamp").alias("effective_to"), F.lit("s").alias("source"))
    found = pricing.price_sums_in_time(rows, prices)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.groupBy("matches", "rates", "rate_sum").count().collect()] == [(20_000, 20_000, decimal.Decimal(40_000), 20_000)]


def test_buckets_let_little_through(spark):
    """Over a whole price history, what buckets let through is at most twice what applies, and nothing is broadcast."""
    quotes = bridge.quotes(spark, SF.replace("0.001", "0.01")).filter("effective_to is not null")
    at = F.col("effective_from") + F.make_dt_interval(F.lit(3))
    rows = quotes.select(*PRICE_KEY, at.alias("timestamp"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met, kept = (pricing.price_join_in_time(rows, quotes, "inner", 14, in_time=x) for x in (False, True))
        n, m = met.count(), kept.count()
        assert quotes.count() > 50_000 and 0 < m <= n <= 2 * m
        assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def files(store):
    return {f.split("/costs/")[1] for f in glob.glob(f"{store}/costs/provider=*/usage_date=*/*.parquet")}


def told(rows):
    return Counter((r["provider"], r["request_id"], r["exact"], r["status"]) for r in rows.collect())


def test_only_touched_days_are_repriced(spark, tmp_path):
    usage, prices, store = bridge.usage(spark, SF), bridge.prices(spark), str(tmp_path / "store")
    assert stored_costs.reprice_stored(usage, prices, store) == 1
    first = files(store)
    assert told(stored_costs.stored_costs(spark, store)) == told(pricing.priced_usage(usage, prices))
    assert stored_costs.reprice_stored(usage, prices, store) == 1 and files(store) == first
    # one model costs more on two days
    turn = lambda n: F.lit(day(n)).cast("timestamp")
    one = (F.col("model_id") == "gpt-5.5") & (F.col("token_category") == "output")
    own = prices.filter(one)
    new = prices.filter(~one).unionByName(own.withColumn("effective_to", turn(9))).unionByName(own.withColumn("effective_from", turn(11))).unionByName(
        own.withColumns({"effective_from": turn(9), "effective_to": turn(11), "rate_per_1m_tokens": F.lit("99").cast("decimal(18,6)")}))
    # the same list in other pieces: an interval that is cut is a changed one, so this provider's days are computed again
    assert stored_costs.reprice_stored(usage, new, store) == 2
    second = files(store)
    assert told(stored_costs.stored_costs(spark, store)) == told(pricing.priced_usage(usage, new))
    assert {f for f in first if f.startswith("provider=claude")} == {f for f in second if f.startswith("provider=claude")}
    # only the rate between the cuts changes: two days are computed
    dearer = new.withColumn("rate_per_1m_tokens", F.when(one & (F.col("effective_from") == turn(9)), F.lit("77").cast("decimal(18,6)")).otherwise(F.col("rate_per_1m_tokens")))
    assert stored_costs.reprice_stored(usage, dearer, store) == 3
    third = files(store)
    assert {f.split("/")[1] for f in third - second} == {"usage_date=2024-01-10", "usage_date=2024-01-11"} and all("codex" in f for f in third - second)
    assert told(stored_costs.stored_costs(spark, store)) == told(pricing.priced_usage(usage, dearer))


def test_a_lost_repricing_is_done_again(spark, tmp_path, monkeypatch):
    usage, prices, store = bridge.usage(spark, SF), bridge.prices(spark), str(tmp_path / "store")
    old = F.substring_index("request_id", "-", -1).cast("long") % 2 == 0
    stored_costs.reprice_stored(usage.filter(old), prices, store)
    dear = prices.withColumn("rate_per_1m_tokens", (F.col("rate_per_1m_tokens") * 2).cast("decimal(18,6)"))
    write = stored_costs._write

    def lost(rows, store, mode):
        write(rows.filter("provider = 'codex'"), store, mode)
        raise RuntimeError("lost")

    monkeypatch.setattr(stored_costs, "_write", lost)
    try:
        stored_costs.reprice_stored(usage.filter(old), dear, store)
    except RuntimeError:
        pass
    monkeypatch.setattr(stored_costs, "_write", write)
    assert stored_costs.stored_prices(spark, store)[0] == 1
    assert stored_costs.reprice_stored(usage.filter(old), dear, store) == 2
    assert told(stored_costs.stored_costs(spark, store)) == told(pricing.priced_usage(usage.filter(old), dear))
    assert stored_costs.costed(usage, store).filter("status = 'absent'").count() == usage.filter(~old).count()
    for _ in range(2):
        stored_costs.cost_new(usage, store)
    assert told(stored_costs.stored_costs(spark, store)) == told(pricing.priced_usage(usage, dear))


def test_late_rows_are_counted_apart(spark, tmp_path):
    row = lambda at, session, n=1: ("codex", session, at, *[n] * 7)
    from meterlake.operators.reports import SUMS

    kinds = "provider string, session_id string, timestamp timestamp, " + ", ".join(f"{c} long" for c in SUMS)
    parts = [[row(day(0, 1), "a"), row(day(0, 1), "a"), row(day(0, 1), "b"), row(day(0, 9), "a")], [row(day(0, 9), "c")], [row(day(0, 2), "late"), row(day(1), "d")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema(f"{kinds}, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = streaming.final_rollup(stream, "hourly").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    got = sorted((r["period_start"].hour, r["request_count"], r["session_count"], r["total_tokens"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 3, 2, 3), (9, 2, 2, 2)] and streaming.late_rows(q) == 1


def slow_fold(prices, fresh):
    """Snapshot rows applied one after the other, by key; None where one is stale or ambiguous."""
    rows = [dict(p) for p in prices]
    for x in sorted(fresh, key=lambda r: r["position"]):
        opened = [r for r in rows if r["effective_to"] is None]
        if len(opened) > 1:
            return None
        new = {k: v for k, v in x.items() if k != "position"}
        if not opened:
            rows.append(new)
        elif opened[0]["rate_per_1m_tokens"] == new["rate_per_1m_tokens"]:
            opened[0]["source"] = new["source"]
        elif new["effective_from"] > opened[0]["effective_from"]:
            opened[0]["effective_to"] = new["effective_from"]
            rows.append(new)
        elif new["effective_from"] == opened[0]["effective_from"]:
            opened[0].update({k: new[k] for k in ("rate_per_1m_tokens", "source", "effective_to")})
        else:
            return None
    return rows


def test_several_snapshot_rows_of_a_key(spark):
    """Up to five rows a key, empty texts beside nulls, against a loop."""
    rng = random.Random(7)
    cols = [c.split()[0] for c in PRICES.replace("(18,6)", "").split(", ")]
    row = lambda m, tier, start, end, rate: dict(zip(cols, ("p", m, "input", tier, None, None, None, None, "USD", decimal.Decimal(rate), day(start), end, f"s{rng.randint(0, 3)}"), strict=True))
    stored, fresh = [], []
    for i in range(150):
        tier = rng.choice([None, "", "x"])
        stored += [row(f"m{i}", tier, s, day(s + 1), rng.randint(1, 3)) for s in (1, 3)] + [row(f"m{i}", tier, 5, None, rng.randint(1, 3))] * (i % 7 != 0)
        start = 4 if i % 11 == 0 else 5
        for k in range(rng.randint(1, 5)):
            start += rng.choice([0, 1, 2])
            fresh.append(row(f"m{i}", tier, start, rng.choice([None, None, None, day(start + 2)]), rng.randint(1, 3)) | {"position": len(fresh)})
        if i % 2:  # the same key but for a null
            stored.append(row(f"m{i}", None if tier == "" else "", 2, None, 2))
    key = lambda r: tuple(r[c] for c in PRICE_KEY)
    bad, want = set(), Counter()
    for k in {key(r) for r in stored + fresh}:
        got = slow_fold([r for r in stored if key(r) == k], [r for r in fresh if key(r) == k])
        if got is None:
            bad.add(k)
        else:
            want.update(tuple(r[c] for c in cols) for r in got)
    df = lambda rows, kinds: spark.createDataFrame([tuple(r.values()) for r in rows], kinds).repartition(3)
    prices, snapshot = df(stored, PRICES), df(fresh, f"{PRICES}, position long")
    problems = catalog.fold(prices, snapshot).filter("problem is not null").collect()
    assert {key(r) for r in problems} == bad and 3 < len(bad) < 100
    good = df([r for r in fresh if key(r) not in bad], f"{PRICES}, position long")
    kept = df([r for r in stored if key(r) not in bad], PRICES)
    assert Counter(tuple(r[c] for c in cols) for r in catalog.refresh(kept, good).collect()) == want
    with pytest.raises(catalog.CatalogError):
        catalog.refresh(prices, snapshot)


def test_running_sums_price_like_components(spark):
    """Overlapping, repeated, empty and reversed intervals: one join per request finds what every component by itself finds."""
    usage, base = bridge.usage(spark, SF), bridge.prices(spark)
    dice = lambda salt, n: F.pmod(F.xxhash64(*PRICE_KEY, "i", F.lit(salt)), F.lit(n)).cast("int")
    start = F.date_add(F.lit("2023-12-30").cast("date"), dice(1, 30))
    prices = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6)))).filter(dice(0, 3) > 0).withColumns({
        "effective_from": F.when(dice(5, 9) > 0, start.cast("timestamp")),
        "effective_to": F.when(dice(2, 8) > 0, F.date_add(start, dice(3, 9) - 1).cast("timestamp")),
        "rate_per_1m_tokens": (F.col("rate_per_1m_tokens") + dice(4, 7)).cast("decimal(18,6)"),
        "currency": F.when(dice(6, 10) > 0, "USD").otherwise("EUR")}).drop("i")
    prices = spark.createDataFrame(prices.collect(), prices.schema)
    want = pricing.request_costs(usage, components.explode_components(usage), prices).select("request_id", "exact", "status")
    want, got = (Counter(map(str, x.collect())) for x in (want, pricing.priced_usage(usage, prices).select("request_id", "exact", "status")))
    assert got == want
    assert len({s.split("status=")[1] for s in got}) >= 3
    # no prices at all
    none = Counter(r["status"] for r in pricing.priced_usage(usage, prices.limit(0)).collect())
    assert set(none) <= {"missing", "integrity", "priced"} and none["missing"] > 0


def test_a_busy_day_is_not_one_tasks(spark, tmp_path):
    usage, prices = bridge.usage(spark, SF).withColumn("timestamp", F.lit(day(3)).cast("timestamp")), bridge.prices(spark)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512")
        stored_costs.reprice_stored(usage.repartition(8), prices, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(glob.glob(f"{tmp_path}/costs/provider=codex/usage_date=2024-01-04/*.parquet")) > 1
    want = Counter((r["request_id"], r["exact"]) for r in pricing.priced_usage(usage, prices).collect())
    assert Counter((r["request_id"], r["exact"]) for r in stored_costs.stored_costs(spark, str(tmp_path)).collect()) == want


def test_repriced_requests_are_not_shuffled(spark):
    plan = QUERIES["J14_reprice"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(provider" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "request_id" in x]
