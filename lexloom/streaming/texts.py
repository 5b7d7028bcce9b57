"""The cleaning decisions over a stream: each micro-batch is scored and filtered; rows already seen within the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import scoring


def accepted(stream: DataFrame, thresholds: Mapping[str, Any], rules: Iterable[Mapping[str, Any]] = (), text_col: str = "text", time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows of a streaming (or batch) table that pass the filters; with time_col each text once within delay."""
    rows = scoring.score(stream, text_col).withColumn("reason", scoring.reason(thresholds, (), rules)).where("reason is null").drop("reason")
    if time_col is None:
        return rows
    return rows.withWatermark(time_col, delay).withColumn("__sha", F.sha2(text_col, 256)).dropDuplicatesWithinWatermark(["__sha"]).drop("__sha")
