"""Incremental maintenance: what changed, whom it affects, and the next snapshot of a table.

Tables are immutable snapshots; "upsert" and "delete" are anti-joins and unions that give the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.lineage import cut

#: Keys up to which a join of all edges broadcasts them.
BROADCAST_KEYS = 250_000


def diff_sources(current: DataFrame, existing: DataFrame) -> DataFrame:
    """``source, status``: added, changed, deleted or unchanged (J11, U01). Both sides: ``source, content_hash``."""
    a, b = current.select("source", F.col("content_hash").alias("new")), existing.select("source", F.col("content_hash").alias("old"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, "source", "full").select("source", status.alias("status"))


def affected_ids(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical ids of nodes and edges that the sources contributed to, and edges of such nodes (J14). Takes provenance.

    Edges are read once and stay where they are while the sources and nodes are few: all edges of a source or a node would meet in one task.
    More are joined by a shuffle, where adaptive execution splits what a hub makes large.
    """
    near = lambda df, few: F.broadcast(df) if few else df
    hit = sources.select("source").where("source IS NOT NULL").distinct()
    few_sources = hit.count() <= BROADCAST_KEYS
    node_ids = cut(nodes.join(near(hit, few_sources), "source", "left_semi").select("canonical_id").distinct())
    few_nodes = node_ids.count() <= BROADCAST_KEYS
    out = edges.select("canonical_id", "source", "from_id", "to_id")
    for keys, end, few in ((hit, "source", few_sources), (node_ids, "from_id", few_nodes), (node_ids, "to_id", few_nodes)):
        out = out.join(near(keys.toDF(end).withColumn(f"{end}_hit", F.lit(True)), few), end, "left")
    return node_ids, out.where("source_hit OR from_id_hit OR to_id_hit").select("canonical_id").distinct()


def delta(old_ids: DataFrame, new_ids: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids to write and ids to delete: affected before or now, and present or not (U02). All have ``id``."""
    affected = old_ids.select("id").unionByName(new_ids.select("id")).distinct()
    return affected.join(present.select("id"), "id", "left_semi"), affected.join(present.select("id"), "id", "left_anti")


def row_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``*key, change``: insert, update, delete or keep of every row (K03, K05, U03), by the hash of all other columns."""
    rest = [c for c in new.columns if c not in key]
    digest = lambda df, name: df.select(*key, F.xxhash64(*[F.col(f"`{c}`") for c in rest]).alias(name))
    both = digest(old, "__o").join(digest(new, "__n"), key, "full")
    change = F.when(F.col("__o").isNull(), "insert").when(F.col("__n").isNull(), "delete").when(F.col("__o") != F.col("__n"), "update").otherwise("keep")
    return both.select(*key, change.alias("change"))


def replace_sources(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """The table with all rows of the new rows' sources replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def delete_keys(old: DataFrame, keys: DataFrame, key: str = "source") -> DataFrame:
    """The table without the keys."""
    return old.join(keys.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table with new rows in place of old ones of the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def apply_delta(old: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """Deletes, then upserts, without touching other rows."""
    return upsert(delete_keys(old, deletes, key), upserts, [key])


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    line = Window.partitionBy(*key).orderBy(order.desc())
    return rows.withColumn("__r", F.row_number().over(line)).where("__r = 1").drop("__r")


def reusable_embeddings(embeddings: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Document embeddings of sources that stay as they are."""
    return embeddings.join(unchanged.select("source"), "source", "left_semi")
