"""The catalogue of knowledge scopes: names for folders under ``documents``."""

from __future__ import annotations

import json
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession


class ScopeError(ValueError):
    """A catalogue that cannot be used."""


def parse_scopes(text: str) -> dict[str, str]:
    """Scope names, folded, and their folders."""
    try:
        catalogue = json.loads(text)
    except json.JSONDecodeError as e:
        raise ScopeError(f"the scope catalogue is not JSON: {e}") from e
    if not isinstance(catalogue, dict) or not all(isinstance(v, str) for v in catalogue.values()):
        raise ScopeError("the scope catalogue must map names to folders")
    out: dict[str, str] = {}
    for raw, folder in catalogue.items():
        name, path = raw.strip().casefold(), PurePosixPath(folder.replace("\\", "/").strip().rstrip("/"))
        if not name or name == "all" or name in out:
            raise ScopeError(f"scope name {raw!r} is empty, reserved or given twice")
        if not path.parts or path.parts[0] != "documents" or {".", ".."} & set(folder.replace("\\", "/").split("/")):
            raise ScopeError(f"scope {raw!r} must lie inside documents/")
        out[name] = str(path)
    return out


def load_scopes(path: str | Path) -> dict[str, str]:
    """The catalogue of a file; none without one."""
    place = Path(path)
    return parse_scopes(place.read_text(encoding="utf-8")) if place.exists() else {}


def scope_frame(spark: SparkSession, scopes: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(scopes.items()), "scope string, prefix string")
