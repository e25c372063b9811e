"""Reading the input tables, cutting lineage in the shared folder, and schemas of packed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from berrak.sources.storage import shared_dir, table, written

__all__ = ["packed_schema", "quoted", "shared_dir", "table", "written"]


def quoted(name: str) -> str:
    """A column's name so that dots and spaces in it are its own."""
    return "`" + name.replace("`", "``") + "`"


def packed_schema(source: DataFrame, more: str) -> StructType:
    """The schema of the struct ``doc`` of ``source`` and of further columns."""
    return StructType([source.schema["doc"], *StructType.fromDDL(more).fields])
