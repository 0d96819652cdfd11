"""Which codes occur, and how often."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class InventorySpec:
    table: str
    columns: tuple[str, ...]
    aliases: tuple[str, ...]

    def __post_init__(self):
        if not self.columns or len(self.columns) != len(self.aliases):
            raise ValueError("an inventory names as many aliases as columns, at least one")

    @property
    def source_column(self) -> str:
        """The column behind the alias ``code``, else the first."""
        return self.columns[self.aliases.index("code")] if "code" in self.aliases else self.columns[0]


def code_inventory(get: Callable[[str], DataFrame], specs: list[InventorySpec]) -> list[DataFrame]:
    """One table per spec: the aliases, COUNT and source_column; NULL is a group of its own."""
    if not specs:
        raise ValueError("there is at least one inventory")
    return [
        get(s.table)
        .groupBy(*[F.col(f"`{c}`").alias(a) for c, a in zip(s.columns, s.aliases, strict=True)])
        .agg(F.count(F.lit(1)).alias("COUNT"))
        .withColumn("source_column", F.lit(s.source_column))
        for s in specs
    ]
