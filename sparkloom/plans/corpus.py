"""Building and maintaining a knowledge base from documents, and searching it.

A synchronisation computes everything first and publishes once: what fails leaves the published version as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.identity import INGESTION_TAG, content_hash, text_hash
from sparkloom.functions.text import node_embedding_text
from sparkloom.lineage import cut
from sparkloom.operators.chunking import TokenCounter, chunk_documents, neighbors, pattern_tokens
from sparkloom.operators.graph_build import EXTRACTION_SCHEMA, build_chunk_graphs, document_counters, extraction_misses
from sparkloom.operators.provenance import combine_graphs, graph_errors, keep_sources, materialize_edges, materialize_nodes
from sparkloom.operators.resolution import MIN_SIMILARITY, Resolver, embeddings_of, missing_embeddings, oldest_first, relation_context, remap_edges, resolve_documents, resolve_into, with_signals
from sparkloom.operators.retrieval import MAX_HOPS, TOP_CHUNKS, TOP_PATHS, annotations, chunk_retriever, context_text, fuse, graph_retriever, in_scope, page_ranges, path_lines, scoped_vectors, searchable_text
from sparkloom.operators.sync import delete_keys, diff_sources, replace_sources
from sparkloom.operators.taxonomy import suggestion_records
from sparkloom.plans.agent import Hit
from sparkloom.sources.clients import EmbeddingClient, ExtractionClient, embed_texts, extract_chunks
from sparkloom.sources.store import SnapshotStore

NODE_PROVENANCE = "canonical_id string, ord long, source string, content_hash string, node_id string, label string, type string, suggested_type string, aliases array<string>, properties string, chunk_ids array<string>, resolution_aliases array<string>"
EDGE_PROVENANCE = "canonical_id string, ord long, source string, content_hash string, edge_id string, from_id string, to_id string, label string, properties string, chunk_ids array<string>"
_NO_STRINGS = "CAST(array() AS array<string>)"


def _extraction_key(model: str) -> Column:
    """The cache key of a chunk's extraction: what the model is shown, and which model (§1.5)."""
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.array_join("heading_path", " > "), "text"), 256)


@dataclass
class Corpus:
    """A knowledge base in a snapshot store.

    A resolver made by ``make_resolver`` embeds with the same model as ``embedder``: it is given the vectors that are known.
    """

    store: SnapshotStore
    extractor: ExtractionClient
    embedder: EmbeddingClient | None = None
    make_resolver: Callable[[], Resolver] | None = None
    min_similarity: float = MIN_SIMILARITY
    count: TokenCounter = pattern_tokens
    tag: str = INGESTION_TAG
    options: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.store.load(name)
        except FileNotFoundError:
            return self.spark.createDataFrame([], schema)

    def changes(self, documents: DataFrame) -> DataFrame:
        """``source, status`` of documents ``source, markdown`` against what is published."""
        current = documents.select("source", content_hash(F.col("markdown"), self.tag).alias("content_hash"))
        return diff_sources(current, self._table("graph_metadata", "source string, content_hash string"))

    def generate(self, documents: DataFrame) -> dict[str, DataFrame]:
        """Chunks, document graphs, their vectors and suggestions of documents (G01): one pass over what is new.

        Extractions are published before anything is made of them, so a lost executor never asks the model again for what a
        graph already rests on, and a failure later on keeps what the model said.
        """
        chunks = cut(chunk_documents(documents, count=self.count, **self.options))
        keyed = chunks.withColumn("key", _extraction_key(self.extractor.model))
        cache = self._table("extractions", f"key string, {EXTRACTION_SCHEMA}")
        _, misses = extraction_misses(keyed.select("key", "id", "text", "heading_path"), cache.select("key"))
        if not misses.isEmpty():
            self.store.commit({"extractions": cache.unionByName(extract_chunks(misses, self.extractor, EXTRACTION_SCHEMA))})
            cache = self.store.load("extractions")
        extractions = keyed.select("key", F.col("id").alias("chunk_id")).join(cache.select("key", "nodes", "edges"), "key").select("chunk_id", "nodes", "edges")
        graphs = build_chunk_graphs(chunks, extractions)
        line = F.format_string("%010d:%06d", "index", "number")
        order = chunks.select(F.col("id").alias("chunk_id"), "index")
        meta = documents.select("source", content_hash(F.col("markdown"), self.tag).alias("content_hash"))
        nodes = graphs.nodes.join(order, "chunk_id").withColumn("place", line)
        nodes = cut(nodes.select("source", "place", "chunk_id", "id", "label", "type", "suggested_type", F.expr(_NO_STRINGS).alias("aliases"), F.lit("{}").alias("properties"), F.array("chunk_id").alias("chunk_ids")))
        edges = graphs.edges.join(order, "chunk_id").withColumn("place", line).select("source", "place", F.concat_ws("/", "chunk_id", "id").alias("id"), "from_id", "to_id", "label", F.lit("{}").alias("properties"), F.array("chunk_id").alias("chunk_ids"))
        suggestions = suggestion_records(nodes.withColumn("ord", F.xxhash64("source", "place")))
        nodes, edges = self._within(nodes, cut(edges), meta)
        when = F.current_timestamp().alias("created_at")
        made = {"chunks": chunks, "graph_metadata": meta, "graph_nodes": nodes, "graph_edges": edges, "taxonomy_suggestions": suggestions, "document_counters": document_counters(graphs.counters)}
        made["dropped_edges"] = graphs.dropped.select("source", "chunk_id", "edge_id", "label", "source_ref", "target_ref", "missing", when)
        if self.embedder is not None:
            made["graph_embeddings"] = self._node_vectors(nodes, edges).join(nodes.select("id", "source"), "id")
        return made

    def _within(self, nodes: DataFrame, edges: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes of a document that are one become one, under the id of the first, and its edges follow."""
        if self.make_resolver is None:
            return nodes, edges
        rows = nodes.join(meta, "source").select(F.col("id").alias("canonical_id"), F.col("place").alias("ord"), "source", "content_hash", F.col("id").alias("node_id"), "label", "type", "suggested_type", "aliases", "properties", "chunk_ids", F.expr(_NO_STRINGS).alias("resolution_aliases"))
        vectors = self._node_vectors(nodes, edges) if self.embedder is not None else self.spark.createDataFrame([], "id string, vector array<float>")
        ids = cut(resolve_documents(with_signals(rows, relation_context(nodes, edges.withColumnRenamed("place", "ord")), vectors), self.make_resolver))
        parts = rows.drop("resolution_aliases", "canonical_id").join(ids, ["source", "node_id"]).withColumnRenamed("entity_id", "canonical_id")
        first = parts.groupBy(F.col("canonical_id").alias("id")).agg(F.first("source").alias("source"), F.min("ord").alias("place"), F.min_by(F.get("chunk_ids", F.lit(0)), "ord").alias("chunk_id"))
        merged = materialize_nodes(parts).drop("n_provenance").join(first, "id").select(*nodes.columns)
        mapped = remap_edges(edges, ids.select(F.col("node_id").alias("old_id"), F.col("entity_id").alias("new_id")))
        key = Window.partitionBy("source", "from_id", "to_id", "label").orderBy("place")
        mapped = mapped.withColumn("canonical_id", F.first("id").over(key)).withColumn("ord", F.col("place"))
        kept = mapped.groupBy(F.col("canonical_id").alias("id")).agg(F.first("source").alias("source"), F.min("place").alias("place"))
        return cut(merged), cut(materialize_edges(mapped).drop("n_provenance").join(kept, "id").select(*edges.columns))

    def _node_vectors(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """``id, embedding_model, text_hash, vector`` of nodes by their text and what their edges say (A21, G15): known vectors are used
        again, wherever they were stored, distinct missing ones made."""
        order = edges.withColumn("ord", F.col("place") if "place" in edges.columns else F.col("id"))
        said = relation_context(nodes, order)
        text = node_embedding_text(F.col("label"), F.col("type"), F.col("suggested_type"), F.col("aliases"), F.col("properties"), F.coalesce("relations", F.expr(_NO_STRINGS)))
        return cut(self._embedded(nodes.join(said, "id", "left").select("id", text.alias("text")), "graph_embeddings", "kb_embeddings"))

    def synchronize(self, documents: DataFrame) -> dict[str, list[str]]:
        """Brings the knowledge base in line with all documents and publishes once (G11). Returns sources by status."""
        status = cut(self.changes(documents))
        lists = {s: [] for s in ("added", "changed", "deleted", "unchanged")}
        for source, s in status.orderBy("source").collect():  # names of documents, one short row each
            lists[s].append(source)
        if not (lists["added"] or lists["changed"] or lists["deleted"]) and self.store.exists("kb_nodes"):
            return lists
        new = documents.join(status.where("status IN ('added', 'changed')"), "source", "left_semi")
        gone = status.where("status IN ('changed', 'deleted')").select("source")
        made = self.generate(new)
        tables: dict[str, DataFrame] = {}
        for name in ("chunks", "graph_metadata", "graph_nodes", "graph_edges", "taxonomy_suggestions", "document_counters", "graph_embeddings"):
            if name in made:
                rows = made[name]
                schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
                tables[name] = replace_sources(delete_keys(self._table(name, schema), gone), rows)
        dropped = made["dropped_edges"]
        tables["dropped_edges"] = self._table("dropped_edges", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dropped.schema.fields)).unionByName(dropped)
        # What no chunk asks for any more leaves the cache, that of deleted documents above all.
        live = tables["chunks"].select(_extraction_key(self.extractor.model).alias("key"))
        tables["extractions"] = self._table("extractions", f"key string, {EXTRACTION_SCHEMA}").join(live, "key", "left_semi")
        tables |= self._merged(made["graph_nodes"], made["graph_edges"], made["graph_metadata"], gone)
        if self.embedder is not None:
            tables["chunk_embeddings"] = self._embedded(searchable_text(tables["chunks"], tables["kb_nodes"], tables["kb_edges"]), "chunk_embeddings")
        self.store.commit(tables)
        return lists

    def _merged(self, nodes: DataFrame, edges: DataFrame, meta: DataFrame, gone: DataFrame | None) -> dict[str, DataFrame]:
        """The knowledge base's tables without what is gone and with what is new; from nothing where ``gone`` is None."""
        known = lambda name, schema: self.spark.createDataFrame([], schema) if gone is None else delete_keys(self._table(name, schema), gone)
        old_nodes, old_edges = known("kb_node_provenance", NODE_PROVENANCE), known("kb_edge_provenance", EDGE_PROVENANCE)
        none = F.expr(_NO_STRINGS).alias("resolution_aliases")
        ordered = _numbered(nodes.join(meta, "source")).withColumn("ord", self._next(old_nodes) + F.col("ord"))
        rows = ordered.select(F.col("id").alias("canonical_id"), "ord", "source", "content_hash", F.col("id").alias("node_id"), "label", "type", "suggested_type", "aliases", "properties", "chunk_ids", none)
        if self.make_resolver is None:
            ids = rows.select("source", "node_id", F.col("node_id").alias("entity_id"), "resolution_aliases")
        else:
            ids = self._resolved(old_nodes, old_edges, rows, edges)
        ids = cut(ids)
        joined = rows.drop("canonical_id", "resolution_aliases").join(ids, ["source", "node_id"]).withColumnRenamed("entity_id", "canonical_id")
        numbered = _numbered(edges.join(meta, "source")).withColumn("ord", self._next(old_edges) + F.col("ord"))
        for end in ("from_id", "to_id"):
            m = ids.select("source", F.col("node_id").alias(end), "entity_id")
            numbered = numbered.join(m, ["source", end], "left").withColumn(end, F.coalesce("entity_id", end)).drop("entity_id")
        fresh = numbered.select(F.col("id").alias("edge_id"), "ord", "source", "content_hash", "from_id", "to_id", "label", "properties", "chunk_ids")
        key = F.concat(F.lit("edge-"), F.left(F.sha2(F.concat_ws("\x00", "from_id", "to_id", "label"), 256), F.lit(16)))
        fresh = fresh.withColumn("canonical_id", key).select(*old_edges.columns)
        node_parts, edge_parts = cut(old_nodes.unionByName(joined.select(*old_nodes.columns))), cut(old_edges.unionByName(fresh))
        out = {"kb_node_provenance": node_parts, "kb_edge_provenance": edge_parts, "kb_nodes": materialize_nodes(node_parts), "kb_edges": materialize_edges(edge_parts)}
        if self.embedder is not None:
            out["kb_embeddings"] = self._node_vectors(out["kb_nodes"], out["kb_edges"])
        return out

    def _next(self, rows: DataFrame) -> Column:
        most = rows.agg(F.max("ord")).first()[0]
        return F.lit(0 if most is None else most + 1).cast("long")

    def _resolved(self, old_nodes: DataFrame, old_edges: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """``source, node_id, entity_id, resolution_aliases``: new documents' nodes among the known entities, with relations and vectors."""
        entities, known_edges = materialize_nodes(old_nodes), materialize_edges(old_edges)
        fresh = rows.select(F.col("canonical_id").alias("id"), "label", "type", "suggested_type", "aliases", "properties")
        none = self.spark.createDataFrame([], "id string, vector array<float>")
        sides = []
        for parts, nodes, lines in ((old_nodes, entities, known_edges.withColumn("place", F.col("id"))), (rows, fresh, edges)):
            vectors = self._node_vectors(nodes, lines) if self.embedder is not None else none
            sides.append(cut(with_signals(parts, relation_context(nodes, lines.withColumn("ord", F.col("place"))), vectors)))
        return resolve_into(*sides, self.make_resolver, self.min_similarity)

    def _embedded(self, texts: DataFrame, *names: str) -> DataFrame:
        """Vectors of texts: known ones are reused, distinct missing ones made."""
        schema = "id string, embedding_model string, text_hash string, vector array<float>"
        inputs = cut(texts.select("id", "text", text_hash(F.col("text")).alias("text_hash")))
        known = self._table(names[0], schema).select("embedding_model", "text_hash", "vector")
        for name in names[1:]:
            known = known.unionByName(self._table(name, schema).select(*known.columns))
        made = embed_texts(missing_embeddings(inputs, known, self.embedder.model), self.embedder)
        return embeddings_of(inputs, known.unionByName(made.select(*known.columns)), self.embedder.model)

    def rebuild(self) -> int:
        """The knowledge base from all document graphs, published anew (G12): through the resolver where there is one, else by ids, given as
        by ``combine_graphs``."""
        meta, nodes, edges = (self.store.load(n) for n in ("graph_metadata", "graph_nodes", "graph_edges"))
        if self.make_resolver is not None:
            return self.store.commit(self._merged(nodes, edges, meta, None))
        n = _numbered(nodes.join(meta, "source")).select(F.col("id").alias("canonical_id"), "ord", "source", "content_hash", F.col("id").alias("node_id"), "label", "type", "suggested_type", "aliases", "properties", "chunk_ids", F.expr(_NO_STRINGS).alias("resolution_aliases"))
        e = _numbered(edges.join(meta, "source")).select(F.col("id").alias("canonical_id"), "ord", "source", "content_hash", F.col("id").alias("edge_id"), "from_id", "to_id", "label", "properties", "chunk_ids")
        kb_nodes, kb_edges = combine_graphs(n, e)
        return self.store.commit({"kb_nodes": kb_nodes, "kb_edges": kb_edges, "kb_node_provenance": n, "kb_edge_provenance": e})

    def errors(self) -> DataFrame:
        """What is wrong with the published graph; empty if nothing (P10)."""
        return graph_errors(self.store.load("kb_nodes"), self.store.load("kb_edges"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``ord``, counting from 0 by source and place, without gathering them in one task."""
    return oldest_first(rows.withColumn("__line", F.concat_ws("\x00", "source", "place")), "__line").withColumn("ord", F.col("rank").cast("long")).drop("__line", "rank")


class Search:
    """Searches of one version of a knowledge base (G16, G17): prepared once, also per scope, asked by batches of queries."""

    def __init__(self, store: SnapshotStore, scopes: dict[str, str] | None = None, embedder: EmbeddingClient | None = None) -> None:
        self.store, self.scopes, self.embedder = store, scopes or {}, embedder
        self.prepared: dict[str | None, tuple] = {}

    def prepare(self) -> None:
        """Takes the published version; later ones are not seen until this is called again."""
        if not self.store.exists("kb_nodes"):
            raise FileNotFoundError("no knowledge base has been published; synchronise documents first")
        for table in getattr(self, "tables", {}).values():
            table.unpersist()
        self.tables = {n: self.store.load(n).persist() for n in ("chunks", "kb_nodes", "kb_edges", "kb_node_provenance", "kb_edge_provenance")}
        self.vectors = self._vectors("chunk_embeddings")
        self.prepared = {None: self._retrievers(self.tables["chunks"], self.tables["kb_nodes"], self.tables["kb_edges"], self._vectors("kb_embeddings"))}

    def _vectors(self, name: str) -> DataFrame | None:
        """``id, vector`` of the present model, if vectors are asked for and stored."""
        if self.embedder is None or not self.store.exists(name):
            return None
        return self.store.load(name).where(F.col("embedding_model") == self.embedder.model).select("id", "vector")

    def _retrievers(self, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, node_vectors: DataFrame | None = None) -> tuple:
        """Both sides; vectors of nodes are those of whole entities, so only the search of the whole knowledge base uses them."""
        return chunks, nodes, edges, chunk_retriever(chunks, nodes, edges, scoped_vectors(self.vectors, chunks)), graph_retriever(chunks, nodes, edges, node_vectors)

    def _scoped(self, scope: str) -> tuple:
        """Only chunks below the scope's folder, and what their sources say of the graph."""
        chunks = self.tables["chunks"].where(in_scope(F.col("source"), self.scopes[scope]))
        nodes, edges = keep_sources(self.tables["kb_node_provenance"], self.tables["kb_edge_provenance"], chunks.select("source").distinct())
        return self._retrievers(chunks, materialize_nodes(nodes), materialize_edges(edges))

    def search(self, queries: DataFrame, *, scope: str | None = None, top_chunks: int = TOP_CHUNKS, top_paths: int = TOP_PATHS, max_hops: int = MAX_HOPS) -> dict[str, DataFrame]:
        """Hits, references, graph paths and context texts of ``query_id, query`` rows."""
        if not self.prepared:
            raise RuntimeError("prepare() has not been called")
        name = scope.strip().casefold() if scope is not None else None
        if name is not None and name not in self.scopes:
            raise ValueError(f"unknown scope {scope!r}; known are: {', '.join(self.scopes) or 'none'}")
        if name not in self.prepared:
            self.prepared[name] = self._scoped(name)
        chunks, nodes, edges, direct, graph = self.prepared[name]
        if self.embedder is not None and self.vectors is not None:
            hashed = queries.select("query_id", "query", F.col("query").alias("text"), text_hash(F.col("query")).alias("text_hash"))
            made = embed_texts(hashed.select("text_hash", "text").dropDuplicates(["text_hash"]), self.embedder).select("text_hash", "vector")
            queries = cut(hashed.join(made, "text_hash").select("query_id", "query", "vector"))
        paths = graph.best_paths(queries, max_hops=max_hops, top_paths=top_paths)
        hits = cut(fuse(direct.rank(queries, top_chunks), graph.rank(paths, top_chunks), chunks, top_chunks))
        placed = hits.join(chunks.select("id", "source", "page_start", "page_end"), "id")
        lines = path_lines(paths, nodes, edges)
        return {"hits": hits, "paths": paths, "references": page_ranges(placed), "context": context_text(queries, hits, chunks, annotations(chunks, nodes, edges), lines)}

    def neighborhood(self, source: str, chunk: str) -> DataFrame:
        """A chunk and its neighbours."""
        return neighbors(self.tables["chunks"], source, chunk)


def agent_tools(search: Search) -> tuple[Callable[[str, str | None], list[Hit]], Callable[[str, str], tuple[Hit | None, Hit, Hit | None]]]:
    """What an ``Agent`` calls, over a prepared search (X06): the hits of one query, and a chunk with its neighbours. A handful of rows each."""
    columns = ["source", "id", "text", "page_start", "page_end", "heading_path"]
    hit = lambda r: Hit(r.source, r.id, r.text, r.page_start, r.page_end, tuple(r.heading_path or ()))

    def find(query: str, scope: str | None) -> list[Hit]:
        if not query.strip():
            raise ValueError("a search needs a query")
        asked = search.store.spark.createDataFrame([(0, query.strip())], "query_id int, query string")
        found = search.search(asked, scope=scope)["hits"].join(search.tables["chunks"].select(*columns), "id")
        return [hit(r) for r in found.orderBy("rank").collect()]

    def around(source: str, chunk: str) -> tuple[Hit | None, Hit, Hit | None]:
        by_place = {r.place: hit(r) for r in search.neighborhood(source, chunk).collect()}
        return by_place.get(-1), by_place[0], by_place.get(1)

    return find, around
