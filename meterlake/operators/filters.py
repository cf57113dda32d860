"""One conjunctive filter over usage."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FAMILIES, report_day


@dataclass(frozen=True)
class UsageFilter:
    """Unset parts filter nothing.  Days are inclusive and in the report zone ``tz``."""

    begin: dt.date | None = None
    end: dt.date | None = None
    provider: str | None = None
    model: str | None = None
    model_family: str | None = None
    project: str | None = None
    session: str | None = None
    subagents: bool = True
    tz: str = "UTC"

    def apply(self, usage: DataFrame) -> DataFrame:
        out = usage
        day = report_day("timestamp", self.tz)
        ntz = usage.schema["timestamp"].dataType.typeName()
        if self.begin is not None:
            # the widened range on the raw column reaches the scan and prunes; the local day decides
            out = out.filter(F.col("timestamp") >= F.lit(dt.datetime.combine(self.begin - dt.timedelta(days=1),
                        dt.time())).cast(ntz)).filter(day >= F.lit(self.begin))
        if self.end is not None:
            out = out.filter(F.col("timestamp") < F.lit(dt.datetime.combine(self.end + dt.timedelta(days=2),
                        dt.time())).cast(ntz)).filter(day <= F.lit(self.end))
        if self.provider is not None:
            out = out.filter(F.col("provider") == self.provider)
        if self.model is not None:
            wanted = F.col("model_id") == self.model
            if self.model.lower() in FAMILIES:
                wanted = wanted | (F.col("model_family") == self.model.lower())
            out = out.filter(wanted)
        if self.model_family is not None:
            out = out.filter(F.col("model_family") == self.model_family.lower())
        if self.project is not None:
            out = out.filter(F.col("project").ilike("%" + self.project.replace("\\", "\\\\") + "%"))
        if self.session is not None:
            out = out.filter(F.col("session_id").ilike(self.session.replace("\\", "\\\\") + "%"))
        if not self.subagents:
            out = out.filter(~F.col("is_subagent"))
        return out
