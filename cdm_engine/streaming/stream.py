"""The stateless operators as they run on streams, and those that need a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codelist import match_codelist
from ..operators.concepts import Rule, extract_concepts
from ..operators.quality import drop_missing


def concept_stream(tables: dict[str, DataFrame], rules: list[Rule], cutoff: str | None = None) -> DataFrame:
    """Concept records of a stream: rows against broadcast rules, without state."""
    return extract_concepts(tables, rules, cutoff)


def complete_rows(stream: DataFrame, columns: list[str]) -> DataFrame:
    return drop_missing(stream, columns)


def first_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key that arrives within the watermark; later copies are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_inventory(stream: DataFrame, columns: list[str], time: str, delay: str, width: str) -> DataFrame:
    """Counts of code combinations per window of event time."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width), *columns).agg(F.count(F.lit(1)).alias("COUNT"))
    return counted.select(F.col("window.start").alias("window_start"), *columns, "COUNT")


def matching_sink(codelist: DataFrame, write: Callable[[DataFrame, int], None], **options) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch of inventory rows is matched to the codelist (choosing the best
    prefix needs a whole batch)."""

    def each(batch: DataFrame, number: int) -> None:
        write(match_codelist(batch, codelist, **options), number)

    return each
