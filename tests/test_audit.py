"""Audits read their inputs once and find what their single checks find."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterlake.functions import columns as C
from meterlake.operators import audit, components
from meterlake.plans.queries import Tables, _broken
from meterlake.schemas import PRICE_KEY, USAGE, USAGE_KEY

SF = "/root/testdata/sf0.001"
COMPONENTS = "provider string, request_id string, model_id string, timestamp timestamp, token_category string, tokens long, service_tier string, speed string, region string, processing_mode string, source_detail string"


def some_usage(spark, n=60, seed=3):
    rng, names, rows = random.Random(seed), [c.split()[0] for c in USAGE.split(", ")], []
    for i in range(n):
        row = dict.fromkeys(names) | {"provider": rng.choice(["codex", "claude-code", None]), "request_id": rng.choice([f"r{i}", f"r{i}", f"r{i // 2}", None]), "model_id": "m"}
        row |= {c: rng.choice([0, 0, 5, 7, None]) for c in names if c.endswith("_tokens") and c != "total_tokens"}
        rows.append(tuple(row[c] for c in names))
    return spark.createDataFrame(rows, USAGE)


def some_components(spark, n=400, seed=4):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        dims = [rng.choice([None, None, None, "", "x"]) for _ in range(5)]
        rows.append((rng.choice(["codex", "claude-code", "claude-code", None]), rng.choice([f"r{rng.randint(0, 70)}", f"r{rng.randint(0, 5)}", None]), "m", dt.datetime(2024, 1, 1),
                rng.choice([*C.CATEGORIES, "images", "audio", None]), rng.choice([5, 7, 0, -5, None]), *dims))
    return spark.createDataFrame(rows, COMPONENTS)


def each_check(usage, parts, selected):
    own = usage if selected is None else selected
    out = Counter()
    for step, issue, df in ((1, "Orphan", audit.orphans(usage, parts).select(*USAGE_KEY, "token_category", F.lit(None), "tokens")),
            (2, "Duplicate", audit.duplicates(parts).select(*USAGE_KEY, "token_category", F.lit(1), "n")),
            (3, "Mismatch", audit.mismatches(own, parts).select(*USAGE_KEY, "token_category", "expected", "actual")),
            (4, "Unexpected", audit.unexpected(own, parts).select(*USAGE_KEY, "token_category", F.lit(0), "actual"))):
        out.update((step, issue, *r) for r in df.collect())
    return out


@pytest.mark.parametrize("narrow", [False, True])
def test_one_pass_finds_what_four_checks_find(spark, narrow):
    usage, parts = some_usage(spark).cache(), some_components(spark).cache()
    selected = usage.filter("provider = 'codex'") if narrow else None
    got, want = Counter(tuple(r) for r in audit.integrity(usage, parts, selected).collect()), each_check(usage, parts, selected)
    assert got == want and {w[0] for w in want} == {1, 2, 3, 4}
    assert audit.integrity(usage, parts, selected, 7).count() == 7
    assert audit.integrity(usage.limit(0), parts.limit(0)).count() == 0


def test_one_pass_finds_seeded_defects(spark):
    t = Tables(spark, SF, True)
    got = Counter(tuple(r) for r in audit.integrity(t.usage, _broken(t)).collect())
    assert got == each_check(t.usage, _broken(t), None) and len({w[0] for w in got}) == 4


def test_integrity_reads_and_deals_its_inputs_once(spark, tmp_path):
    some_usage(spark).write.parquet(f"{tmp_path}/usage")
    some_components(spark).write.parquet(f"{tmp_path}/parts")
    plan = audit.integrity(spark.read.parquet(f"{tmp_path}/usage"), spark.read.parquet(f"{tmp_path}/parts"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_prices_are_met_once(spark):
    t = Tables(spark, SF, True)
    parts, met = _broken(t), audit.observed_prices(_broken(t), t.prices)
    seen = met.groupBy(*PRICE_KEY).agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    assert Counter(map(tuple, seen.collect())) == Counter(map(tuple, audit.observations(parts).select(seen.columns).collect()))
    columns = ["provider", "model_id", "token_category", "effective_from", "effective_to", "source"]
    want = audit.used_sources(parts, t.prices, t.sources).select(columns)
    assert Counter(map(tuple, met.filter("charged").select(columns).distinct().collect())) == Counter(map(tuple, want.collect()))


def test_row_checks_are_compiled(spark):
    t = Tables(spark, SF)
    raw = t.usage.selectExpr("provider", "model_id", "'input' AS token_category", "cast(timestamp AS string) AS timestamp", *(f"cast(NULL AS string) AS {d}" for d in C.DIMENSIONS),
        "'USD' AS currency", "'x' AS rate_per_1m_tokens", "'' AS effective_from", "'' AS effective_to", "'s' AS source")
    for df in (components.explode_components(t.usage), audit.usage_row_problems(raw), audit.price_row_problems(raw)):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_ordinals_count_parts_with_tokens(spark):
    rows = components.explode_components(some_usage(spark).withColumn("uuid", F.monotonically_increasing_id().cast("string")).withColumn("model_id", F.col("uuid"))).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["component_ordinal"]):
        by.setdefault(r["model_id"], []).append(r)
    order = [(c, d) for c, d, _ in components.component_parts()]
    for own in by.values():
        assert [r["component_ordinal"] for r in own] == list(range(len(own))) and all(r["tokens"] > 0 for r in own)
        assert (at := [order.index((r["token_category"], r["source_detail"])) for r in own]) == sorted(set(at))


def test_canonical_texts_are_those_that_are_written(spark):
    day = "2024-02-29"
    texts = [f"{day}T01:02:03{f}{z}" for f in ("", ".5", ".500", ".000", ".123456", ".123000", ".000001", ".123456789") for z in ("+00:00", "-00:00", "Z", "z", "+02:00", "", "+00:00\n")]
    texts += ["2023-02-29T01:02:03+00:00", f"{day}T24:00:00+00:00", f"{day}T23:59:60+00:00", f"{day} 01:02:03+00:00", f"{day}t01:02:03+00:00", "0000-01-01T00:00:00+00:00",
        "0001-01-01T00:00:00+00:00", "1500-03-01T00:00:00+00:00", "9999-12-31T23:59:59.999999+00:00", "12024-01-01T00:00:00+00:00", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ts = C.parse_instant("t")
    old = F.when(ts.isNull(), "invalid").when(~F.col("t").rlike(r"([Zz]|[+-]00:00)$"), "not_utc").when(F.col("t") != C.format_utc(ts), "not_canonical")
    rows = df.select("t", C.utc_problem("t").alias("got"), old.alias("want"), C.is_canonical_utc("t").alias("ok")).collect()
    assert [(r["t"], r["got"]) for r in rows] == [(r["t"], r["want"]) for r in rows]
    assert all(r["ok"] == (r["t"] is not None and r["want"] is None) for r in rows) and sum(r["ok"] for r in rows) > 4
