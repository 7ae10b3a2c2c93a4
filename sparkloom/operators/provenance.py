"""Canonical nodes and edges as folds over their provenance.

Provenance rows are the source of truth; a canonical row is an ordered fold over them ("first wins"). ``ord`` carries
the order. The folds are aggregations: firsts by ``min_by``, unique lists by an aggregation on what makes them unique, so no
task has to sort out a whole list on its own.

Node provenance: ``canonical_id, ord, source, content_hash, node_id, label, type, suggested_type, aliases, properties,
chunk_ids, resolution_aliases``. Edge provenance: ``canonical_id, ord, source, content_hash, edge_id, from_id, to_id, label,
properties, chunk_ids``. ``properties`` is canonical JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import UNCLASSIFIED, normal_name, normal_type

NODE_FIELDS = ["source", "content_hash", "node_id", "label", "type", "suggested_type", "aliases", "properties", "chunk_ids", "resolution_aliases"]
EDGE_FIELDS = ["source", "content_hash", "edge_id", "from_id", "to_id", "label", "properties", "chunk_ids"]


def _empty() -> Column:
    return F.array().cast("array<string>")


def unique_lists(rows: DataFrame, key: list[str], value: str, unique: Column, order: list[str]) -> DataFrame:
    """``*key, value array``: values in order, the first of each ``unique``."""
    first = rows.withColumn("__u", unique).groupBy(*key, "__u").agg(F.min(F.struct(*order, F.col(value).alias("__v"))).alias("__f"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("__f")), lambda f: f["__v"]).alias(value))


def materialize_nodes(provenance: DataFrame) -> DataFrame:
    """``id, label, type, suggested_type, aliases, properties, chunk_ids, n_provenance``."""
    p = provenance
    has_type = normal_type(F.col("type")) != UNCLASSIFIED
    has_suggestion = F.coalesce(F.col("suggested_type"), F.lit("")) != ""
    base = p.groupBy(F.col("canonical_id").alias("id")).agg(
        F.min_by("label", "ord").alias("label"),
        F.coalesce(F.min_by(F.when(has_type, F.col("type")), F.when(has_type, F.col("ord"))), F.min_by("type", "ord")).alias("type"),
        F.min_by(F.when(has_suggestion, F.col("suggested_type")), F.when(has_suggestion, F.col("ord"))).alias("suggested_type"),
        F.min_by("properties", "ord").alias("properties"),
        F.count(F.lit(1)).alias("n_provenance"),
    )
    first = base.select("id", normal_name(F.col("label")).alias("__first"))
    # A label that differs from the first one is an alias; it comes before the aliases of its own row.
    names = F.concat(F.array("label"), F.coalesce("aliases", _empty()), F.coalesce("resolution_aliases", _empty()))
    names = p.select(F.col("canonical_id").alias("id"), "ord", F.posexplode(names).alias("pos", "alias")).withColumn("__n", normal_name(F.col("alias")))
    names = names.join(first, "id").where((F.col("__n") != "") & (F.col("__n") != F.col("__first")))
    aliases = unique_lists(names, ["id"], "alias", F.col("__n"), ["ord", "pos"])
    chunks = p.select(F.col("canonical_id").alias("id"), "ord", F.posexplode("chunk_ids").alias("pos", "chunk"))
    chunks = unique_lists(chunks, ["id"], "chunk", F.col("chunk"), ["ord", "pos"])
    out = base.join(aliases, "id", "left").join(chunks, "id", "left")
    return out.select("id", "label", "type", "suggested_type", F.coalesce("alias", _empty()).alias("aliases"), "properties", F.coalesce("chunk", _empty()).alias("chunk_ids"), "n_provenance")


def materialize_edges(provenance: DataFrame) -> DataFrame:
    """``id, from_id, to_id, label, properties, chunk_ids, n_provenance``."""
    base = provenance.groupBy(F.col("canonical_id").alias("id")).agg(*[F.min_by(c, "ord").alias(c) for c in ("from_id", "to_id", "label", "properties")], F.count(F.lit(1)).alias("n_provenance"))
    chunks = provenance.select(F.col("canonical_id").alias("id"), "ord", F.posexplode("chunk_ids").alias("pos", "chunk"))
    chunks = unique_lists(chunks, ["id"], "chunk", F.col("chunk"), ["ord", "pos"])
    return base.join(chunks, "id", "left").select("id", "from_id", "to_id", "label", "properties", F.coalesce("chunk", _empty()).alias("chunk_ids"), "n_provenance")


def keep_sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provenance of the given sources only; edges that lose an end go (P07). Takes and returns provenance."""
    kept = nodes.join(sources.select("source"), "source", "left_semi")
    return kept, _with_ends(edges.join(sources.select("source"), "source", "left_semi"), kept.select("canonical_id"))


def remove_sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame, lone_nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Provenance without the given sources (P08, P09); ``lone_nodes`` (``canonical_id``) are nodes that never had any and stay."""
    kept = nodes.join(sources.select("source"), "source", "left_anti")
    ids = kept.select("canonical_id")
    ids = ids.unionByName(lone_nodes.select("canonical_id")) if lone_nodes is not None else ids
    return kept, _with_ends(edges.join(sources.select("source"), "source", "left_anti"), ids)


def _with_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    ids = ids.distinct()
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.withColumnRenamed("canonical_id", end), end, "left_semi")
    return edges


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``error, id``: repeated ids and edges with unknown ends (P10); self-loops are fine."""
    twice = lambda df, what: df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"repeated {what}").alias("error"), "id")
    lost = lambda end, what: edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti").select(F.lit(f"unknown {what}").alias("error"), "id")
    return twice(nodes, "node").unionByName(twice(edges, "edge")).unionByName(lost("from_id", "source")).unionByName(lost("to_id", "target"))


def group_edges(edges: DataFrame) -> DataFrame:
    """Edge provenance with the canonical id of the first edge of the same ends and label."""
    key = Window.partitionBy("from_id", "to_id", "label")
    first = F.min(F.struct("ord", F.col("canonical_id").alias("i"))).over(key)
    return edges.withColumn("first_ord", first["ord"]).withColumn("canonical_id", first["i"])


#: Ids that may have been given by ``allocate_edge_ids``.
GIVEN_ID = r"^edge-\d{4,}$"


def allocate_edge_ids(first_edges: DataFrame, used: list[str] | None = None, keep: bool = True) -> DataFrame:
    """The edges with ``new_id``, in order of ``key_ord`` and then of their other columns: a kept id is its own unless taken; others get the lowest free ``edge-NNNN``
    (A12, §1.5).

    The first edge of an id of another form keeps it whatever else happens. Only the rest, ids of the given form and repeated ones,
    depend on all before them and are folded in one task, on a few columns.
    """

    def run(batches):
        taken, next_free = set(used or ()), 1
        for batch in batches:
            out = []
            for edge, again in zip(batch["edge_id"], batch["again"], strict=True):
                if not keep or again or edge in taken:
                    while f"edge-{next_free:04d}" in taken:
                        next_free += 1
                    edge = f"edge-{next_free:04d}"
                    next_free += 1
                taken.add(edge)
                out.append(edge)
            yield batch.drop(columns="again").assign(new_id=out)

    columns = ["key_ord", *sorted(c for c in first_edges.columns if c != "key_ord")]
    first = F.row_number().over(Window.partitionBy("edge_id").orderBy(*columns))
    rows = first_edges.select(*columns).withColumn("again", F.lit(False))
    free = F.lit(False)
    if keep:
        taken = F.col("edge_id").isin(list(used)) if used else F.lit(False)
        rows = rows.withColumn("again", (first > 1) & ~F.col("edge_id").rlike(GIVEN_ID) | taken)
        free = ~F.col("again") & ~F.col("edge_id").rlike(GIVEN_ID)
    kept = rows.where(free).select(*columns, F.col("edge_id").alias("new_id"))
    schema = ", ".join(f"`{c}` {first_edges.schema[c].dataType.simpleString()}" for c in columns)
    folded = rows.where(~free).repartition(1).sortWithinPartitions(*columns).mapInPandas(run, f"{schema}, new_id string")
    return kept.unionByName(folded)


def combine_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provenance of many document graphs as one graph: nodes by id, edges by ends and label, ids kept or given anew."""
    grouped = group_edges(edges)
    # Edges of unlike ends or labels may begin at one place, and an edge may begin with several rows.
    key = ["first_ord", "from_id", "to_id", "label"]
    firsts = grouped.where("ord = first_ord").groupBy(*key).agg(F.min("edge_id").alias("edge_id")).withColumnRenamed("first_ord", "key_ord")
    ids = allocate_edge_ids(firsts).withColumnRenamed("key_ord", "first_ord").select(*key, "new_id")
    renamed = grouped.join(ids, key).withColumn("canonical_id", F.col("new_id")).drop("new_id", "first_ord")
    return materialize_nodes(nodes), materialize_edges(renamed)
