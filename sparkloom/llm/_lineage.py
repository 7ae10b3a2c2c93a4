"""What operators need beside the engine's own cutting of lineage: free column names and hashes of whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.lineage import cut, remove, shared_dir

__all__ = ["cut", "remove", "row_hash", "shared_dir", "spare"]


def spare(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A hash of whole rows; columns that Spark does not hash (maps) count by their JSON text."""
    odd = lambda c: any(k in df.schema[c].dataType.simpleString() for k in ("map<", "variant"))
    return F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if odd(c) else F.col(f"`{c}`") for c in (df.columns if columns is None else columns)])
