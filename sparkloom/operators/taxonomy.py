"""The type registry, suggestions for new types, and their promotion.

suggestions: ``suggested_type, normalized, node_id, node_label, current_type, source, chunk_id, created_at, ord``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import UNCLASSIFIED, normal_type
from sparkloom.operators.provenance import unique_lists

# The node types that extraction may give.
NODE_TYPES = [
    "concept", "feature", "capability", "tool", "integration", "product", "service", "organization", "person", "document", "repository",
    "package", "plugin", "model", "process", "system", "agent", "environment", "event_trigger", "resource", "unclassified",
]
MIN_NODES, MIN_SOURCES = 5, 2


@dataclass(frozen=True)
class Registry:
    """Known types and their descriptions; the version counts promotions."""

    version: int = 1
    types: dict[str, str] = field(default_factory=lambda: dict.fromkeys(NODE_TYPES, ""))

    def promoted(self, names: list[str]) -> "Registry":
        """With new types, under the next version."""
        new = {n: f"Promoted from suggested type {n}." for n in names if n not in self.types}
        return Registry(self.version + 1, {**self.types, **new}) if names else self

    def type_list(self) -> str:
        return ", ".join(self.types)


def suggestion_records(nodes: DataFrame) -> DataFrame:
    """Suggestions of nodes: those whose suggested type is not blank once normalised (G14). nodes: ``id, label, type, suggested_type,
    source, chunk_id, ord``."""
    out = nodes.where("suggested_type IS NOT NULL").withColumn("normalized", normal_type(F.col("suggested_type"))).where("normalized <> ''")
    return out.select("suggested_type", "normalized", F.col("id").alias("node_id"), F.col("label").alias("node_label"), F.col("type").alias("current_type"), "source", "chunk_id", F.current_timestamp().alias("created_at"), "ord")


def aggregate_suggestions(suggestions: DataFrame) -> DataFrame:
    """Per normal type: distinct nodes and sources, and the lists in first-seen order."""
    keyed = suggestions.withColumn("node_key", F.concat_ws(":", "source", "node_id"))
    counts = keyed.groupBy("normalized").agg(F.countDistinct("node_key").alias("node_count"), F.countDistinct("source").alias("source_count"))
    out = counts
    for column, name in (("suggested_type", "suggested_types"), ("node_key", "node_ids"), ("source", "sources")):
        lists = unique_lists(keyed, ["normalized"], column, F.col(column), ["ord"]).withColumnRenamed(column, name)
        out = out.join(lists, "normalized")
    return out


def promotable(aggregates: DataFrame, registry: Registry, min_nodes: int = MIN_NODES, min_sources: int = MIN_SOURCES) -> DataFrame:
    """Aggregates with enough nodes and sources whose type is not registered."""
    known = list(registry.types)
    # Fixed value: the wording that stored audits have.
    reason = F.format_string("Appeared in %d nodes across %d source documents.", "node_count", "source_count")
    return aggregates.where((F.col("node_count") >= min_nodes) & (F.col("source_count") >= min_sources) & ~F.col("normalized").isin(known)).withColumn("reason", reason)


def migrate(nodes: DataFrame, promoted: DataFrame) -> DataFrame:
    """Unclassified nodes whose suggestion is promoted take it as their type (G13). promoted: ``normalized``, a few types."""
    names = F.broadcast(promoted.select(F.col("normalized").alias("__p")))
    moved = (normal_type(F.col("type")) == UNCLASSIFIED) & F.col("suggested_type").isNotNull()
    out = nodes.join(names, F.when(moved, normal_type(F.col("suggested_type"))) == F.col("__p"), "left")
    hit = F.col("__p").isNotNull()
    return out.withColumns({"type": F.when(hit, F.col("__p")).otherwise(F.col("type")), "suggested_type": F.when(~hit, F.col("suggested_type")), "migrated": hit}).drop("__p")


def affected_nodes(migrated: DataFrame) -> DataFrame:
    """``type, affected array``: the nodes that each promotion changed, as ``source:id``."""
    key = F.when(F.coalesce("source", F.lit("")) == "", F.col("id")).otherwise(F.concat_ws(":", "source", "id"))
    return unique_lists(migrated.where("migrated").withColumn("affected", key), ["type"], "affected", F.col("affected"), ["ord"])


def evolve(registry: Registry, suggestions: DataFrame, nodes: DataFrame, min_nodes: int = MIN_NODES, min_sources: int = MIN_SOURCES) -> tuple[Registry, DataFrame, DataFrame]:
    """The next registry, the migrated nodes and the promotions with what they changed."""
    chosen = promotable(aggregate_suggestions(suggestions), registry, min_nodes, min_sources)
    names = [r[0] for r in chosen.select("normalized").orderBy("normalized").collect()]  # new types, a handful
    migrated = migrate(nodes, chosen)
    promotions = chosen.join(affected_nodes(migrated).withColumnRenamed("type", "normalized"), "normalized", "left")
    return registry.promoted(names), migrated, promotions.withColumn("affected", F.coalesce("affected", F.array().cast("array<string>")))
