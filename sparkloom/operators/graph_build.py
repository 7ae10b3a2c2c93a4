"""Chunk graphs from extracted nodes and edges: structural nodes and dangling edges leave, the rest gets ids.

chunks: ``id, source, index, heading_path``. extractions: ``chunk_id, nodes array<struct<ref, label, type, suggested_type>>,
edges array<struct<id, source_ref, target_ref, label>>``. All joins are on the chunk, so a chunk's rows meet in one partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.identity import edge_id, node_id
from sparkloom.functions.text import normal_text

# Normal types and labels that stand for the document's structure.
STRUCTURAL_TYPES = ["chunk", "column", "file path", "heading", "link", "markdown table", "row", "source", "source path", "table", "url"]
STRUCTURAL_LABELS = ["chunk", "column", "document", "file path", "heading", "markdown table", "row", "source", "source path", "table"]

EXTRACTED_NODE = "struct<ref:string,label:string,type:string,suggested_type:string>"
EXTRACTED_EDGE = "struct<id:string,source_ref:string,target_ref:string,label:string>"
EXTRACTION_SCHEMA = f"chunk_id string, nodes array<{EXTRACTED_NODE}>, edges array<{EXTRACTED_EDGE}>"


def extraction_errors(extractions: DataFrame) -> DataFrame:
    """``chunk_id, error``: repeated references, and unclassified nodes with no suggested type (§1.2)."""
    nodes = extractions.select("chunk_id", F.explode("nodes").alias("n"))
    twice = nodes.groupBy("chunk_id", "n.ref").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("chunk_id", F.concat(F.lit("repeated ref "), F.col("ref")).alias("error"))
    blank = F.trim(F.coalesce("n.suggested_type", F.lit(""))) == ""
    bad = ((F.col("n.type") == "unclassified") & blank) | (F.col("n.suggested_type").isNotNull() & blank)
    return twice.unionByName(nodes.where(bad).select("chunk_id", F.concat(F.lit("suggested type missing for "), F.col("n.ref")).alias("error")))


def is_structural(kind: Column, label: Column, chunk: Column, source: Column, headings: Column) -> Column:
    """Whether an extracted node names a piece of the document rather than a thing."""
    name = normal_text(label)
    path = F.when(F.size(headings) > 0, F.array_join(headings, " > ")).otherwise(F.lit("(none)"))
    known = F.transform(F.concat(F.array(path), F.coalesce(headings, F.array().cast("array<string>"))), normal_text)
    inner = F.trim(F.when(name.startswith("chunk "), F.substring(name, 7, 1 << 30)))
    return (
        normal_text(kind).isin(STRUCTURAL_TYPES)
        | name.isin(STRUCTURAL_LABELS)
        | ((name != "") & ((name == normal_text(chunk)) | (name == normal_text(source))))
        | F.coalesce(F.array_contains(F.filter(known, lambda h: h != ""), inner), F.lit(False))
    )


@dataclass(frozen=True)
class ChunkGraphs:
    """nodes: ``chunk_id, source, ref, id, label, type, suggested_type, number``; edges: ``chunk_id, source, id, from_id, to_id,
    label, number``; dropped: ``chunk_id, source, edge_id, label, source_ref, target_ref, missing``; counters: one row per chunk."""

    nodes: DataFrame
    edges: DataFrame
    dropped: DataFrame
    counters: DataFrame


def build_chunk_graphs(chunks: DataFrame, extractions: DataFrame) -> ChunkGraphs:
    """Nodes and edges of every chunk (G04): structural nodes leave with their edges (P02), edges to unknown references are
    set apart (P04), the first edge of each (source, target, label) stays (A13), and ids count what is kept."""
    meta = chunks.select(F.col("id").alias("chunk_id"), "source", "heading_path")
    raw = extractions.join(meta, "chunk_id").select("chunk_id", "source", "heading_path", F.posexplode("nodes").alias("pos", "n"))
    raw = raw.select("chunk_id", "source", "pos", "n.ref", "n.label", "n.type", "n.suggested_type", is_structural(F.col("n.type"), F.col("n.label"), F.col("chunk_id"), F.col("source"), F.col("heading_path")).alias("structural"))
    # A reference is structural if any node of that name is.
    marks = raw.groupBy("chunk_id", "ref").agg(F.max("structural").alias("out"))
    number = F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos"))
    nodes = raw.join(marks, ["chunk_id", "ref"]).where("NOT out").withColumn("number", number)
    nodes = nodes.select("chunk_id", "source", "ref", node_id(F.col("chunk_id"), F.col("number")).alias("id"), "label", "type", "suggested_type", "number")
    # Of repeated references the last names the node.
    refs = nodes.groupBy("chunk_id", "ref").agg(F.max_by("id", "number").alias("id")).join(marks, ["chunk_id", "ref"], "full").select("chunk_id", "ref", "id", "out")

    edges = extractions.join(meta.select("chunk_id", "source"), "chunk_id").select("chunk_id", "source", F.posexplode("edges").alias("pos", "e"))
    edges = edges.select("chunk_id", "source", "pos", F.col("e.id").alias("edge_id"), "e.label", "e.source_ref", "e.target_ref")
    side = lambda tag: refs.select("chunk_id", F.col("ref").alias(f"{tag}_ref"), F.col("id").alias(f"{tag}_id"), F.col("out").alias(f"{tag}_out"))
    edges = edges.join(side("source"), ["chunk_id", "source_ref"], "left").join(side("target"), ["chunk_id", "target_ref"], "left")
    edges = edges.where(~(F.coalesce("source_out", F.lit(False)) | F.coalesce("target_out", F.lit(False))))
    missing = F.filter(F.array(F.when(F.col("source_id").isNull(), "source"), F.when(F.col("target_id").isNull(), "target")), lambda m: m.isNotNull())
    edges = edges.withColumn("missing", missing)
    dropped = edges.where(F.size("missing") > 0).select("chunk_id", "source", "edge_id", "label", "source_ref", "target_ref", "missing")
    first = F.row_number().over(Window.partitionBy("chunk_id", "source_id", "target_id", "label").orderBy("pos"))
    kept = edges.where(F.size("missing") == 0).withColumn("__first", first).where("__first = 1")
    kept = kept.withColumn("number", F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos")))
    kept = kept.select("chunk_id", "source", edge_id(F.col("number")).alias("id"), F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), "label", "number")

    raw_count = extractions.join(meta.select("chunk_id", "source"), "chunk_id").select("chunk_id", "source", F.size("nodes").alias("raw_nodes"), F.size("edges").alias("raw_edges"))
    structural = marks.where("out").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("dropped_structural_nodes"))
    counters = raw_count.join(nodes.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("kept_nodes")), "chunk_id", "left").join(kept.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("kept_edges")), "chunk_id", "left").join(structural, "chunk_id", "left").na.fill(0, ["kept_nodes", "kept_edges", "dropped_structural_nodes"])
    counters = counters.withColumn("dropped_edges", F.col("raw_edges") - F.col("kept_edges"))
    return ChunkGraphs(nodes, kept, dropped, counters)


def document_counters(counters: DataFrame) -> DataFrame:
    """Raw, kept and dropped nodes and edges per source."""
    names = ["raw_nodes", "kept_nodes", "dropped_structural_nodes", "raw_edges", "kept_edges", "dropped_edges"]
    return counters.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), *[F.sum(c).alias(c) for c in names])


def extraction_misses(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests found in the cache, and one row for each distinct key that is not (J12). Both have ``key``."""
    return requests.join(cache, "key"), requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def heading_text(path: Column) -> Column:
    """A heading path in one line, ``(none)`` without one."""
    return F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise("(none)")


def extraction_prompt(text: Column, path: Column, types: list[str]) -> Column:
    """What a model is asked about a chunk (G21): the task with the types that may be given, where the text stands, and the text."""
    task = f"Name the things that this text is about and how they relate, few rather than many. Types: {', '.join(types)}. Nothing of the document's own structure counts."
    return F.concat(F.lit(task + "\n\nIt stands under (not to be used itself): "), heading_text(path), F.lit("\n\n"), text)
