"""A PySpark-native engine for clinical common-data-model tables: load, conform, clean, identify,
harmonise vocabularies, extract concepts and trace them back to their sources."""

from .operators.codelist import match_codelist
from .operators.combine import append_distinct, row_counts
from .operators.concepts import Rule, extract_concepts, rules_from_wide
from .operators.conform import conform
from .operators.identity import assign_ids
from .operators.inventory import InventorySpec, code_inventory
from .operators.layout import Layout, apply_layout
from .operators.provenance import origin_rows, origin_values
from .operators.quality import dedup, drop_missing
from .plans.flow import Engine, Step
from .sources.ingest import load_tables
from .spec import ColumnSpec, Config, TableSpec, read_metadata
from .store import Store

__all__ = [
    "ColumnSpec", "Config", "Engine", "InventorySpec", "Layout", "Rule", "Step", "Store", "TableSpec",
    "append_distinct", "apply_layout", "assign_ids", "code_inventory", "conform", "dedup", "drop_missing",
    "extract_concepts", "load_tables", "match_codelist", "origin_rows", "origin_values", "read_metadata",
    "row_counts", "rules_from_wide",
]
