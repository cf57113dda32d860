"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = ("provider", "model_id", "project")


def shown_columns(report: DataFrame) -> list[str]:
    """Columns without those group columns that no row has."""
    groups = [c for c in GROUPS if c in report.columns]
    if not groups:
        return report.columns
    some = report.agg(*(F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in groups)).first()
    return [c for c in report.columns if c not in groups or some[c]]


def csv_rows(report: DataFrame) -> DataFrame:
    """Raw numbers; cost with six decimals."""
    out = report.select(*shown_columns(report))
    return out.withColumn("cost_usd", F.col("cost_usd").cast("decimal(38,6)").cast("string")) if "cost_usd" in out.columns else out


def write_csv(report: DataFrame, path: str) -> None:
    """With a header even where there are no rows, and quotes doubled inside quotes."""
    csv_rows(report).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_rows(report: DataFrame) -> DataFrame:
    """One JSON object per row; group columns that are not set are left out."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
