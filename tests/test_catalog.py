"""Catalogs, refreshes, gates and streams."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterlake import streaming
from meterlake.operators import pricing, reports
from meterlake.operators.components import explode_components
from meterlake.plans import log_queries
from meterlake.plans.queries import Tables
from meterlake.schemas import PRICES
from meterlake.sources import bridge, catalog, sinks

SF = "/root/testdata/sf0.001"


def price(rate, start, end=None, source="a", category="input"):
    return ("codex", "m", category, None, None, None, "standard", None, "USD", Decimal(rate), start, end, source)


def day(n):
    return dt.datetime(2024, 1, n)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PRICES)


def told(df):
    return sorted((float(r["rate_per_1m_tokens"]), r["effective_from"].day, r["effective_to"] and r["effective_to"].day, r["source"]) for r in df.collect())


@pytest.mark.parametrize(
    ("new", "want", "changes"),
    [
        (price("1", day(5)), [(1.0, 1, None, "a")], 0),
        (price("1", day(5), source="b"), [(1.0, 1, None, "b")], 1),
        (price("2", day(5)), [(1.0, 1, 5, "a"), (2.0, 5, None, "a")], 2),
        (price("2", day(1)), [(2.0, 1, None, "a")], 1),
        (price("3", day(1), category="output"), [(1.0, 1, None, "a"), (3.0, 1, None, "a")], 1),
    ],
)
def test_refresh_of_one_row(spark, new, want, changes):
    stored, snap = frame(spark, price("1", day(1))), frame(spark, new)
    assert told(catalog.refresh(stored, snap)) == want
    assert catalog.refresh_plan(stored, snap).agg(F.sum("changes")).first()[0] == changes


def test_refresh_refuses_older_and_ambiguous_rows(spark):
    with pytest.raises(catalog.CatalogError):
        catalog.refresh(frame(spark, price("1", day(5))), frame(spark, price("2", day(1)))).collect()
    with pytest.raises(catalog.CatalogError):
        catalog.refresh(frame(spark, price("1", day(5)), price("1", day(6))), frame(spark, price("2", day(7)))).collect()


def test_refresh_folds_rows_of_one_key_in_order(spark):
    out = catalog.refresh(frame(spark, price("1", day(1))), frame(spark, price("2", day(5)), price("3", day(9))))
    assert told(out) == [(1.0, 1, 5, "a"), (2.0, 5, 9, "a"), (3.0, 9, None, "a")]


def document(**change):
    entry = {"provider": "codex", "model_ids": ["m1", "m2"], "currency": "USD", "effective_from": "2024-01-01T00:00:00Z", "source": "s", "source_ref": "ref", "dimensions": {"processing_mode": "standard"}, "rates_per_1m_tokens": {"input": 1.5, "output": 6}, "notes": "e"}
    return {"schema_version": 1, "sources": [{"id": "ref", "url": "https://example.org", "retrieved_at": "2024-01-01", "notes": "n"}], "entries": [entry | change]}


def test_catalog_import(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(document(), indent=1))
    prices, sources = catalog.import_catalog(spark, str(path), frame(spark), bridge.sources(spark).limit(0))
    assert prices.count() == 4 and sources.first()["notes"] == "n; e" and sources.first()["source_kind"] == "reviewed"


def test_a_catalog_in_documents_is_one_catalog(spark, tmp_path):
    """Positions run on over documents, sources are told once, the header counts once, and no document is a task's alone to hold."""
    one, two = document(), document(model_ids=["m3"], notes="later")
    more = {"schema_version": 1, "first_position": 1, "entries": two["entries"]}
    for i, x in enumerate((more, one)):
        (tmp_path / f"{i}.json").write_text(json.dumps(x))
    prices, sources = catalog.import_catalog(spark, str(tmp_path), frame(spark), bridge.sources(spark).limit(0))
    assert prices.count() == 6 and [r["notes"] for r in sources.collect()] == ["n; e"]
    whole = catalog.read_catalog(spark, str(tmp_path))
    assert sorted(r["position"] for r in catalog.catalog_entries(whole).collect()) == [0, 1]
    wrong = whole.withColumns({"schema_version": F.lit(2), "sources": F.col("sources").cast("array<struct<id:string,url:string,retrieved_at:string,notes:string>>")})
    assert [r["problem"] for r in catalog.catalog_violations(wrong).collect()] == ["unsupported version"]


def test_made_catalogs_are_no_single_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_queries, "DOCUMENT", 20)
    whole = catalog.read_catalog(spark, log_queries._catalog(Tables(spark, SF)))
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert whole.count() >= n // 20 and whole.agg(F.max(F.size("entries"))).first()[0] <= 20
    assert sum(r["n"] for r in whole.select(F.size("entries").alias("n")).collect()) == n
    assert len({r["position"] for r in catalog.catalog_entries(whole).select("position").collect()}) == n


@pytest.mark.parametrize("change", [{"source_ref": "other"}, {"model_ids": []}, {"rates_per_1m_tokens": {}}, {"source": " "}])
def test_bad_catalogs_are_refused(spark, tmp_path, change):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(document(**change)))
    with pytest.raises(catalog.CatalogError):
        catalog.import_catalog(spark, str(path), frame(spark), bridge.sources(spark).limit(0))


def test_cost_reports_fail_loudly(spark):
    usage = bridge.usage(spark, SF)
    parts, now = explode_components(usage), spark.createDataFrame([("codex", 1), ("claude-code", 1)], "provider string, generation int")
    bad = bridge.defective_prices(spark)
    with pytest.raises((pricing.MissingPricing, pricing.OverlappingPricing)):
        pricing.require_cost(usage, pricing.request_costs(usage, parts, bad), now, parts, bad)
    good = bridge.prices(spark)
    pricing.require_cost(usage, pricing.request_costs(usage, parts, good), now, parts, good)
    assert pricing.record_cost(usage, parts, good, "codex", "req-0") > 0
    with pytest.raises(pricing.MissingPricing):
        pricing.record_cost(usage, parts, good, "codex", "no-such")


def test_daylight_saving_gaps(spark):
    def labels(*instants):
        rows = spark.createDataFrame([("p", f"r{i}", "s", x) for i, x in enumerate(instants)], "provider string, request_id string, session_id string, timestamp timestamp")
        rows = rows.withColumns({c: F.lit(1).cast("long") for c in reports.SUMS}).withColumn("exact", F.lit(0).cast("decimal(38,6)"))
        return lambda tz: [(r["period"][11:], r["request_count"]) for r in reports.rollup(rows, "hourly", tz).collect()]

    la = "America/Los_Angeles"
    assert labels(dt.datetime(2026, 3, 8, 9, 30), dt.datetime(2026, 3, 8, 10, 30))(la) == [("01:00", 1), ("03:00", 1)]
    assert labels(dt.datetime(2026, 11, 1, 8, 30), dt.datetime(2026, 11, 1, 9, 30))(la) == [("01:00", 2)]
    assert labels(dt.datetime(2026, 4, 7, 9, 40), dt.datetime(2026, 4, 7, 10, 40))("Asia/Kolkata") == [("15:00", 1), ("16:00", 1)]


def test_csv_sink_has_a_header_and_quotes(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c', 1, 0.5)], "project string, total_tokens long, cost_usd double").coalesce(1).withColumn("provider", F.lit(None).cast("string"))
    sinks.write_csv(rows, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("*.csv"))
    assert text == 'project,total_tokens,cost_usd\n"a ""b"", c",1,0.500000\n'
    sinks.write_json(rows, str(tmp_path / "json"))
    assert "provider" not in "".join(f.read_text() for f in (tmp_path / "json").glob("*.json"))


def test_streams(spark, tmp_path):
    usage = bridge.usage(spark, SF)
    usage.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(usage.schema).parquet(str(tmp_path / "in"))
    for run in ("one", "two"):
        streaming.append_usage(stream(), str(tmp_path / "store"), str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == usage.count()
    for name, df in (("daily", streaming.rollup(stream(), "daily")), ("parts", streaming.component_costs(stream(), bridge.prices(spark))), ("once", streaming.deduplicated(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "daily" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("daily").agg(F.sum("request_count")).first()[0] == usage.count()
    assert spark.table("parts").filter("rate is null").count() == 0 and spark.table("parts").count() == explode_components(usage).count()
    assert spark.table("once").count() == usage.count()


def test_unknown_report_column():
    from meterlake.functions.columns import report_columns

    assert report_columns(["cost", "date", "cost"]) == ["cost_usd", "period", "cost_usd"]
    with pytest.raises(ValueError):
        report_columns(["nope"])
