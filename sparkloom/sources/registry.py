"""The type registry and the audit of promotions as small JSON files of the shared store."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from sparkloom.operators.taxonomy import Registry
from sparkloom.sources.store import read_text, text_exists, write_text


class RegistryFile:
    """A registry at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return text_exists(self.spark, self.path)

    def save(self, registry: Registry) -> None:
        write_text(self.spark, self.path, json.dumps({"version": registry.version, "types": registry.types}, indent=2))

    def load(self) -> Registry:
        """Raises where nothing is stored, or something else."""
        data = json.loads(read_text(self.spark, self.path))
        if not isinstance(data, dict) or not isinstance(data.get("version"), int) or not isinstance(data.get("types"), dict):
            raise ValueError(f"{self.path} holds no type registry")
        return Registry(data["version"], {str(k): str(v) for k, v in data["types"].items()})

    def load_or_default(self) -> Registry:
        return self.load() if self.exists() else Registry()


class AuditFile:
    """Promotions in the order in which they were made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def load(self) -> list[dict]:
        if not text_exists(self.spark, self.path):
            return []
        records = json.loads(read_text(self.spark, self.path))
        if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
            raise ValueError(f"{self.path} holds no audit")
        return records

    def append(self, records: list[dict]) -> None:
        """Adds records; none leave the file as it is."""
        if records:
            write_text(self.spark, self.path, json.dumps([*self.load(), *records], indent=2, sort_keys=True))
