"""Row keys: what tells the rows of a table apart when doc_ids are null or repeat."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column

KEY = ["ka", "kb"]
KEYS = "ka long, kb long"
#: Stands for a null doc_id: smaller than any other.
NO_ID = -(2**63)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``id`` (a null doc_id: NO_ID) and the row's key ``ka``, ``kb``: 128 bits of doc_id and text, from two
    seeds. Rows with equal keys are copies of one row: alike in doc_id and text."""
    row = (F.col("doc_id").cast("long"), F.col("text"), F.col("text").isNull())
    return docs.withColumns({"id": F.coalesce(row[0], F.lit(NO_ID)), "ka": F.xxhash64(*row), "kb": F.xxhash64(F.lit(7), *row)})


def whole(docs: DataFrame) -> DataFrame:
    """(row, id, ka, kb): a struct of all columns, whatever their names, and the row's key."""
    return keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")).select("row", "id", *KEY)


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The column ``text``, or that field of the column ``row``, without nulls."""
    if "text" in batch.schema.names:
        return column(batch, "text")
    row = batch.column(batch.schema.get_field_index("row"))
    return column(pa.RecordBatch.from_arrays([row.field(row.type.get_field_index("text"))], names=["text"]), "text")


def with_text(batch: pa.RecordBatch, texts: pa.Array, chars: pa.Array) -> pa.RecordBatch:
    """The fields of the column ``row`` with other texts (and ``n_chars``, where there is one)."""
    row = batch.column(batch.schema.get_field_index("row"))
    parts = {f.name: row.field(i) for i, f in enumerate(row.type)}
    parts["text"] = texts
    if "n_chars" in parts:
        parts["n_chars"] = chars.cast(parts["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(parts.values()), names=list(parts))
