"""Doors hold no state, so a door column works unchanged in a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.verdicts import cast_schema


def cast_stream(stream: DataFrame, doors: dict[str, dict]) -> DataFrame:
    return cast_schema(stream, doors)
