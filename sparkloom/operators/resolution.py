"""Entity resolution: which nodes are one entity.

Candidate search is relational: equal normal names, comparable types, and vectors near enough. The decision itself is a fold,
because every merge changes the names, the type and the text that later nodes are compared with. Folds of different documents
are independent and run as one group each; the fold over the whole knowledge base takes only the new nodes and the
canonical rows that can meet them, block by block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import CASE_FOLDS, LONG_PLURALS, UNCLASSIFIED, canonical_json, normal_names, normal_type
from sparkloom.functions.vectors import dot, norm
from sparkloom.lineage import components, cut

TOP_K, MIN_CONFIDENCE, MIN_SIMILARITY = 10, 0.80, 0.80


# --- relational candidate search ---------------------------------------------------------------------------------


def name_matches(incoming: DataFrame, canonical: DataFrame) -> DataFrame:
    """``id, match_id``: the oldest canonical node of a common normal name and a comparable type.

    Both sides: ``id, label, aliases, type``; canonical also ``rank``, its age.
    """
    named = lambda df, *columns: df.select(*columns, normal_type(F.col("type")).alias("t"), F.explode(normal_names(F.col("label"), F.col("aliases"))).alias("name"))
    # A common name would pair all its nodes; of the canonical ones only the oldest of each type, and of all types, can be a match.
    right = named(canonical, F.col("id").alias("match_id"), "rank")
    oldest = lambda df, *key: df.groupBy(*key).agg(F.min_by(F.struct("match_id", "rank"), "rank").alias("m"))
    any_type = F.lit("*")  # no normal type has this form
    right = oldest(right, "name", "t").unionByName(oldest(right, "name").withColumn("t", any_type)).select("name", "t", "m.*")
    left = named(incoming, "id").select("id", "name", F.explode(F.when(F.col("t") == UNCLASSIFIED, F.array(any_type)).otherwise(F.array("t", F.lit(UNCLASSIFIED)))).alias("t"))
    return left.join(right, ["name", "t"]).groupBy("id").agg(F.min_by("match_id", "rank").alias("match_id"))


def type_blocks(incoming: DataFrame, canonical: DataFrame) -> DataFrame:
    """``id, match_id`` pairs of comparable types (J07), as a union of equi-joins: one type, and the two wildcard sides.

    Every pair of a block is a candidate by definition; ``similar_in_blocks`` never lists them.
    """
    left = incoming.select("id", normal_type(F.col("type")).alias("t"))
    right = canonical.select(F.col("id").alias("match_id"), normal_type(F.col("type")).alias("t"))
    wild_right = right.where(F.col("t") == UNCLASSIFIED)
    same = left.join(right, "t").select("id", "match_id")
    to_wild = left.where(F.col("t") != UNCLASSIFIED).withColumn("w", F.lit(UNCLASSIFIED)).join(wild_right.withColumnRenamed("t", "w"), "w").select("id", "match_id")
    from_wild = left.where(F.col("t") == UNCLASSIFIED).withColumn("w", F.lit(1)).join(right.where(F.col("t") != UNCLASSIFIED).withColumn("w", F.lit(1)), "w").select("id", "match_id")
    return same.unionByName(to_wild).unionByName(from_wild)


def similar_in_blocks(incoming: DataFrame, canonical: DataFrame, *, min_similarity: float = MIN_SIMILARITY, top_k: int = TOP_K, slices: int = 16) -> DataFrame:
    """``id, match_id, similarity, place``: the nearest canonical vectors of the same block (J08, R11), ties by id.

    Both sides: ``id, block, vector``. Blocks are matrices in Arrow batches: incoming rows are dealt by block and slice,
    canonical rows of a block are copied to its slices and streamed past, and each incoming row keeps its top k. A block's
    pairs exist only inside a matrix product. A hot block is spread over ``slices`` tasks.
    """
    import pandas as pd

    size = lambda m: np.sqrt((m * m).sum(axis=1))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["id", "match_id", "similarity", "place"], dtype=object)
        right = right.sort_values("other_id", kind="stable")
        # In double precision and rounded past it, so that equal vectors tie wherever they stand in a matrix.
        a, b = np.stack(left["vector"]).astype(np.float64), np.stack(right["other"]).astype(np.float64)
        own_size, other_size = size(a), size(b)
        ids, names, out = left["id"].to_numpy(), right["other_id"].to_numpy(), []
        for first in range(0, len(a), 512):
            sizes = own_size[first : first + 512, None] * other_size
            scores = np.round(np.divide(a[first : first + 512] @ b.T, sizes, out=np.zeros_like(sizes), where=sizes != 0), 13)
            for row, s in enumerate(scores):
                own = ids[first + row]
                fit = np.flatnonzero((s >= min_similarity) & (names != own))
                fit = fit[np.argsort(-s[fit], kind="stable")][:top_k]
                out += [(own, names[k], float(s[k]), place) for place, k in enumerate(fit, 1)]
        return pd.DataFrame(out, columns=["id", "match_id", "similarity", "place"], dtype=object)

    kind, match = incoming.schema["id"].dataType.simpleString(), canonical.schema["id"].dataType.simpleString()
    a = incoming.select(F.col("id").alias("id"), F.col("block").alias("block"), F.col("vector").alias("vector"), F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"))
    b = canonical.select(F.col("id").alias("other_id"), F.col("block").alias("block"), F.col("vector").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    return a.groupBy("block", "slice").cogroup(b.groupBy("block", "slice")).applyInPandas(run, f"id {kind}, match_id {match}, similarity double, place int")


def accepted(decisions: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Decisions with ``accepted_id``: the target of a merge that is a candidate and sure enough, else null."""
    ok = (F.col("decision") == "merge") & F.array_contains("candidate_ids", F.col("target_id")) & (F.col("confidence") >= min_confidence)
    return decisions.withColumn("accepted_id", F.when(ok, F.col("target_id")))


def remap_edges(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Edge ends through ``old_id, new_id``; unknown ids pass through."""
    for end in ("from_id", "to_id"):
        m = id_map.select(F.col("old_id").alias(end), F.col("new_id").alias("__new"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return edges


def relation_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, relations array``: what a node's edges say, in edge order (A21). nodes: ``id, label, type``; edges: ``ord, from_id, to_id, label``."""
    n = lambda tag: nodes.select(F.col("id").alias(f"{tag}_id"), F.col("label").alias(f"{tag}_label"), F.col("type").alias(f"{tag}_type"))
    both = edges.join(n("from"), "from_id").join(n("to"), "to_id")
    out = both.select("ord", F.lit(0).alias("side"), F.col("from_id").alias("id"), F.concat(F.lit("outgoing "), "label", F.lit(" to "), "to_label", F.lit(" ("), "to_type", F.lit(")")).alias("text"))
    back = both.select("ord", F.lit(1).alias("side"), F.col("to_id").alias("id"), F.concat(F.lit("incoming "), "label", F.lit(" from "), "from_label", F.lit(" ("), "from_type", F.lit(")")).alias("text"))
    lists = out.unionByName(back).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "side", "text"))).alias("r"))
    return lists.select("id", F.transform("r", lambda r: r["text"]).alias("relations"))


def missing_embeddings(inputs: DataFrame, known: DataFrame, model: str) -> DataFrame:
    """One row ``text_hash, text`` for each distinct text that no vector of the model covers (G15, P14). inputs: ``id, text, text_hash``."""
    have = known.where(F.col("embedding_model") == model).select("text_hash")
    return inputs.select("text_hash", "text").join(have, "text_hash", "left_anti").dropDuplicates(["text_hash"])


def embeddings_of(inputs: DataFrame, known: DataFrame, model: str) -> DataFrame:
    """``id, embedding_model, text_hash, vector`` of each input whose text a vector covers."""
    have = known.where(F.col("embedding_model") == model).select("text_hash", "vector").dropDuplicates(["text_hash"])
    return inputs.join(have, "text_hash").select("id", F.lit(model).alias("embedding_model"), "text_hash", "vector")


# --- the fold ----------------------------------------------------------------------------------------------------

_GAP = re.compile("[^a-z0-9]+")


@lru_cache(100_000)
def plain_name(text: str) -> str:
    """``normal_name`` for one text."""
    for char, out in CASE_FOLDS.items():
        text = text.replace(char, out)

    def one(word: str) -> str:
        if len(word) > 4 and word.endswith("ies"):
            return word[:-3] + "y"
        if len(word) > 4 and word.endswith(LONG_PLURALS):
            return word[:-2]
        return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word

    return " ".join(one(w) for w in _GAP.split(text.lower()) if w)


@lru_cache(100_000)
def plain_type(text: str) -> str:
    for char, out in CASE_FOLDS.items():
        text = text.replace(char, out)
    return "_".join(w for w in _GAP.split(text.lower()) if w)


@dataclass(frozen=True)
class Contribution:
    """What one document says of a node."""

    source: str
    content_hash: str
    node_id: str
    label: str
    type: str
    suggested_type: str | None = None
    aliases: tuple[str, ...] = ()
    properties: str = "{}"
    chunk_ids: tuple[str, ...] = ()
    resolution_aliases: tuple[str, ...] = ()


class Entity:
    """A canonical node: an id and its contributions in order; everything else follows from them.

    Entities that grow from one another share their contributions, so that a merge costs what it adds: an entity is the first
    ``n`` of them, with the names and types told by those.
    """

    __slots__ = ("_held", "_n", "_names", "aliases", "id", "names", "suggested_type", "type")

    def __init__(self, id: str, parts: Iterable[Contribution]) -> None:
        self.id, self._held, self._n = id, [], 0
        self._names, self.aliases, self.names = frozenset(), (), frozenset()
        self.type, self.suggested_type = None, None
        self._add(tuple(parts))

    def _add(self, parts: tuple[Contribution, ...]) -> None:
        self._held += parts
        first = self._n == 0
        self._n += len(parts)
        if first and parts:
            self._names, self.type = frozenset({plain_name(parts[0].label), ""}), parts[0].type
            self.names = frozenset(n for n in self._names if n)
        if self.type is not None and plain_type(self.type) == UNCLASSIFIED:
            self.type = next((p.type for p in parts if plain_type(p.type) != UNCLASSIFIED), self.type)
        self.suggested_type = self.suggested_type or next((p.suggested_type for p in parts if p.suggested_type), None)
        seen, new = set(), []
        for p in parts:
            for name in (p.label, *p.aliases, *p.resolution_aliases):
                if (key := plain_name(name)) not in self._names and key not in seen:
                    seen.add(key)
                    new.append(name)
        if new:
            self._names, self.aliases, self.names = self._names | seen, (*self.aliases, *new), self.names | seen

    def grown(self, parts: tuple[Contribution, ...]) -> Entity:
        """The entity with more contributions; this one stays as it is."""
        if len(self._held) != self._n:  # another has grown from it
            return Entity(self.id, (*self.parts, *parts))
        out = Entity.__new__(Entity)
        for name in Entity.__slots__:
            setattr(out, name, getattr(self, name))
        out._add(parts)
        return out

    def renamed(self, id: str) -> Entity:
        return Entity(id, self.parts)

    def __eq__(self, other) -> bool:
        return isinstance(other, Entity) and (self.id, self.parts) == (other.id, other.parts)

    def __hash__(self) -> int:
        return hash((self.id, self.parts))

    def __repr__(self) -> str:
        return f"Entity({self.id!r}, {self.parts!r})"

    def since(self, at: int) -> list[Contribution]:
        return self._held[at : self._n]

    @property
    def parts(self) -> tuple[Contribution, ...]:
        return tuple(self._held[: self._n])

    @property
    def label(self) -> str:
        return self._held[0].label

    @property
    def properties(self) -> str:
        return self._held[0].properties

    @property
    def chunk_ids(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for p in self.parts for c in p.chunk_ids))

    def text(self, relations: Iterable[str] = ()) -> str:
        relations = list(dict.fromkeys(relations))
        lines = [f"label: {self.label}", f"type: {self.type}"]
        lines += [f"suggested_type: {self.suggested_type}"] if self.suggested_type else []
        lines += ["aliases: " + ", ".join(self.aliases)] if self.aliases else []
        lines += [f"properties: {self.properties}"] if self.properties not in ("", "{}") else []
        lines += ["relationships: " + "; ".join(relations)] if relations else []
        return "\n".join(lines)


@dataclass
class Decision:
    """A judge's answer: ``merge`` into a target or ``new``."""

    decision: str
    target_id: str | None = None
    confidence: float = 0.0
    aliases_to_add: tuple[str, ...] = ()


Embed = Callable[[list[str]], list[list[float]]]
Judge = Callable[[Entity, list[tuple[Entity, float]]], Decision]


@dataclass
class Resolver:
    """The fold: nodes one after the other, each merged into an older entity or kept as a new one.

    Vectors are made for the distinct texts that have none, many at a time; a merge outdates its entity's vector.
    """

    embed: Embed
    judge: Judge
    top_k: int = TOP_K
    min_confidence: float = MIN_CONFIDENCE
    min_similarity: float = MIN_SIMILARITY
    vectors: dict[str, np.ndarray] = field(default_factory=dict)  # by text
    entities: dict[str, Entity] = field(default_factory=dict)
    order: dict[str, int] = field(default_factory=dict)
    by_name: dict[str, set[str]] = field(default_factory=dict)
    by_type: dict[str, set[str]] = field(default_factory=dict)
    relations: dict[str, list[str]] = field(default_factory=dict)

    def start(self, existing: Iterable[Entity]) -> None:
        for entity in existing:
            self._put(entity)

    def _put(self, entity: Entity) -> None:
        if old := self.entities.get(entity.id):
            if old.names is entity.names and old.type == entity.type:
                self.entities[entity.id] = entity
                return
            for name in old.names:
                self.by_name[name].discard(old.id)
            self.by_type[plain_type(old.type)].discard(old.id)
        self.order.setdefault(entity.id, len(self.order))
        self.entities[entity.id] = entity
        for name in entity.names:
            self.by_name.setdefault(name, set()).add(entity.id)
        self.by_type.setdefault(plain_type(entity.type), set()).add(entity.id)

    def _embed(self, texts: list[str]) -> None:
        new = [t for t in dict.fromkeys(texts) if t not in self.vectors]
        for text, vector in zip(new, self.embed(new) if new else [], strict=True):
            self.learn(text, vector)

    def learn(self, text: str, vector: Iterable[float]) -> None:
        """A vector that is known already."""
        v = np.asarray(vector, np.float32)
        size = np.linalg.norm(v)
        self.vectors[text] = v if size == 0 else v / size

    def text_of(self, entity: Entity) -> str:
        return entity.text(self.relations.get(entity.id, ()))

    def prepare(self, incoming: Iterable[Entity]) -> None:
        """Makes the vectors of all incoming nodes at once."""
        self._embed([self.text_of(e) for e in incoming])

    def _comparable(self, kind: str) -> set[str]:
        if kind == UNCLASSIFIED:
            return set(self.entities)
        return self.by_type.get(kind, set()) | self.by_type.get(UNCLASSIFIED, set())

    def near(self, node: Entity, ids: list[str]) -> list[tuple[Entity, float]]:
        """The candidates that are similar enough, nearest first, ties by id."""
        if not ids:
            return []
        own, texts = self.text_of(node), [self.text_of(self.entities[i]) for i in ids]
        self._embed([own, *texts])
        scores = np.stack([self.vectors[t] for t in texts]) @ self.vectors[own]
        found = [(float(s), i) for s, i in zip(scores, ids, strict=True) if s >= self.min_similarity]
        return [(self.entities[i], s) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[: self.top_k]]

    def add(self, node: Entity, allowed: set[str] | None = None, known: tuple[str, str] | None = None) -> str:
        """Resolves one node and returns its entity's id.

        ``allowed`` freezes the candidates; ``known`` is the (source, content hash) that the node comes from, or None where
        nodes have no source, in which case an equal id is the same node.
        """
        same = self.entities.get(node.id)
        if same and (known is None or any((p.source, p.content_hash, p.node_id) == (*known, node.id) for p in same.parts)):
            return self._merge(same, node)
        kind = plain_type(node.type)
        fit = lambda i: (allowed is None or i in allowed) and (kind == UNCLASSIFIED or any(i in self.by_type.get(k, ()) for k in (kind, UNCLASSIFIED)))
        named = [i for n in node.names for i in self.by_name.get(n, ()) if fit(i)]
        if named:
            return self._merge(self.entities[min(named, key=self.order.__getitem__)], node)
        fits = self._comparable(kind)
        fits = fits if allowed is None else fits & allowed
        candidates = self.near(node, sorted(fits, key=self.order.__getitem__))
        if candidates:
            d = self.judge(node, candidates)
            if d.decision == "merge" and d.confidence >= self.min_confidence and d.target_id in {e.id for e, _ in candidates}:
                return self._merge(self.entities[d.target_id], node, d.aliases_to_add)
        free, n = node.id, 2
        while free in self.entities:
            free, n = f"{node.id}::{n:04d}", n + 1
        self._put(node.renamed(free))
        return free

    def _merge(self, entity: Entity, node: Entity, extra: tuple[str, ...] = ()) -> str:
        parts = tuple(replace(p, resolution_aliases=tuple(dict.fromkeys((*p.resolution_aliases, *extra)))) for p in node.parts)
        self._put(entity.grown(parts))
        return entity.id

    def combine(self, graphs: Iterable[tuple[tuple[str, str] | None, list[Entity]]], *, within: bool) -> dict[str, str]:
        """Resolves graph after graph and returns {node id: entity id}.

        ``within``: a node may also meet the nodes of its own graph; otherwise the candidates are those at the graph's start.
        """
        graphs = list(graphs)
        self.prepare(e for _, nodes in graphs for e in nodes)
        out = {}
        for known, nodes in graphs:
            allowed = None if within else set(self.entities)
            for node in nodes:
                out[node.id] = self.add(node, allowed, known)
        return out


def judge_payload(node: Entity, candidates: list[tuple[Entity, float]]) -> str:
    """What a judge is shown, as text."""
    import json

    one = lambda e: {"id": e.id, "label": e.label, "type": e.type, "suggested_type": e.suggested_type, "aliases": list(e.aliases), "properties": json.loads(e.properties)}
    return canonical_json({"incoming": one(node), "candidates": [{**one(e), "similarity": round(s, 6)} for e, s in candidates]})


RESOLVED = "source string, node_id string, entity_id string, resolution_aliases array<string>"
#: Neighbours by vector that put a node into a block of the fold.
BLOCK_NEIGHBORS = 50


def _text(value) -> str | None:
    return value if isinstance(value, str) and value else None


def _list(value) -> tuple:
    return tuple(value) if value is not None else ()


def _part(r) -> Contribution:
    return Contribution(r.source, r.content_hash, r.node_id, r.label, r.type, _text(r.suggested_type), _list(r.aliases), r.properties or "{}", _list(r.chunk_ids), _list(r.resolution_aliases))


def _fold(frame, make: Callable[[], Resolver], within: bool):
    """Rows of one fold, by ``ord``: known entities' contributions (``fresh`` 0), and new nodes, graph by graph."""
    import pandas as pd

    known: dict[str, list[Contribution]] = {}
    graphs: dict[tuple[str, str], list[Entity]] = {}
    resolver = make()
    told: dict[str, np.ndarray] = {}
    for r in frame.sort_values(["ord", "node_id"]).itertuples(index=False):
        if r.fresh:
            graphs.setdefault((r.source, r.content_hash), []).append(Entity(r.node_id, (_part(r),)))
        else:
            known.setdefault(r.canonical_id, []).append(_part(r))
        if r.relations is not None and len(r.relations):
            resolver.relations[r.canonical_id] = list(r.relations)
        if r.vector is not None:
            told[r.canonical_id] = r.vector
    entities = [Entity(i, tuple(parts)) for i, parts in known.items()]
    for e in [*entities, *(e for nodes in graphs.values() for e in nodes)]:
        if e.id in told:
            resolver.learn(resolver.text_of(e), told[e.id])
    resolver.start(entities)
    out = []
    extras: dict[str, tuple[list[int], dict]] = {}
    for key, nodes in graphs.items():
        ids = resolver.combine([(key, nodes)], within=within)
        for e in nodes:
            # The first contribution of the node; an entity's are looked through once, as they only grow.
            looked, first = extras.setdefault(ids[e.id], ([0], {}))
            for p in resolver.entities[ids[e.id]].since(looked[0]):
                first.setdefault((p.source, p.content_hash, p.node_id), p.resolution_aliases)
                looked[0] += 1
            out.append((key[0], e.id, ids[e.id], list(first.get((*key, e.id), ()))))
    return pd.DataFrame(out, columns=["source", "node_id", "entity_id", "resolution_aliases"], dtype=object)


_FOLDED = ["canonical_id", "ord", "source", "content_hash", "node_id", "label", "type", "suggested_type", "aliases", "properties", "chunk_ids", "resolution_aliases"]


def with_signals(rows: DataFrame, relations: DataFrame, vectors: DataFrame) -> DataFrame:
    """Provenance rows with what a node's edges say and its vector, where there are any. relations: ``id, relations``; vectors: ``id, vector``."""
    r = relations.select(F.col("id").alias("canonical_id"), "relations")
    v = vectors.select(F.col("id").alias("canonical_id"), F.col("vector").cast("array<float>").alias("vector"))
    return rows.select(*_FOLDED).join(r, "canonical_id", "left").join(v, "canonical_id", "left")


def resolve_documents(nodes: DataFrame, make: Callable[[], Resolver]) -> DataFrame:
    """``source, node_id, entity_id, resolution_aliases``: resolution within each document, documents side by side.

    nodes: see ``with_signals``, the canonical id being the node's own. A group is one document's nodes.
    """
    return nodes.withColumn("fresh", F.lit(1)).groupBy("source").applyInPandas(lambda frame: _fold(frame, make, True), RESOLVED)


def fold_blocks(old: DataFrame, new: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``canonical_id, block``: nodes that the fold may bring together, directly or through others.

    Nodes meet by a common normal name, by an equal id, or as neighbours by vector whose types can be compared. Names and ids are
    vertices of their own, so a name that many nodes have costs one link for each.
    """
    every = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    vertex = F.concat(F.when(F.col("fresh") == 1, "n:").otherwise("c:"), "canonical_id")
    names = every.select(vertex.alias("lo"), F.explode(normal_names(F.col("label"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("resolution_aliases", F.array().cast("array<string>"))))).alias("m"))
    links = names.select("lo", F.concat(F.lit("w:"), "m").alias("hi")).unionByName(every.select(vertex.alias("lo"), F.concat(F.lit("i:"), "canonical_id").alias("hi")))
    # Each node stands in the blocks of the types that it can be compared with.
    kind = normal_type(F.col("type"))
    one = every.where("vector IS NOT NULL").groupBy("canonical_id", "fresh").agg(F.min_by("vector", "ord").alias("vector"), F.min_by(kind, "ord").alias("t"))
    one = cut(one.withColumn("id", F.concat(F.when(F.col("fresh") == 1, "n:").otherwise("c:"), "canonical_id")))
    types = one.select(F.col("t").alias("block")).distinct()  # a few dozen
    wild = one.where(F.col("t") == UNCLASSIFIED).crossJoin(F.broadcast(types)).select("id", "block", "vector")
    right = wild.unionByName(one.where(F.col("t") != UNCLASSIFIED).select("id", F.explode(F.array("t", F.lit(UNCLASSIFIED))).alias("block"), "vector"))
    left = one.where("fresh = 1").select("id", F.col("t").alias("block"), "vector")
    near = similar_in_blocks(left, right, min_similarity=min_similarity, top_k=BLOCK_NEIGHBORS)
    links = links.unionByName(near.select(F.col("id").alias("lo"), F.col("match_id").alias("hi"))).distinct()
    found = components(links).select(F.col("node").alias("v"), F.col("component").alias("block"))
    return every.select("canonical_id", "fresh", vertex.alias("v")).distinct().join(found, "v", "left").select("canonical_id", "fresh", F.coalesce("block", "v").alias("block"))


def resolve_into(old: DataFrame, new: DataFrame, make: Callable[[], Resolver], min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``source, node_id, entity_id, resolution_aliases``: new documents' nodes resolved into the known entities.

    Both sides: see ``with_signals``. Candidates are those known when a document begins. The fold runs once for each block of nodes that
    can meet; a merged entity's new text is compared inside its block only.
    """
    rows = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    blocks = cut(fold_blocks(old, new, min_similarity))
    live = blocks.where("fresh = 1").select("block").distinct()
    grouped = rows.join(blocks.join(live, "block", "left_semi"), ["canonical_id", "fresh"])
    return grouped.groupBy("block").applyInPandas(lambda frame: _fold(frame, make, False), RESOLVED)


def connected_entities(pairs: DataFrame, rounds: int = 30) -> DataFrame:
    """``id, entity_id``: a documented approximation of the fold for tables too large for it.

    Nodes linked by ``id, match_id`` pairs, directly or not, become one entity named by its least id. Unlike the fold it
    does not look again at merged names, and order plays no part. Rounds grow with the logarithm of the longest chain of
    links; raises where ``rounds`` of them did not settle the entities.
    """
    both = pairs.select(F.col("id").alias("u"), F.col("match_id").alias("v"))
    found = components(both.select(F.col("u").alias("lo"), F.col("v").alias("hi")), most=rounds)
    ids = both.select(F.col("u").alias("id")).unionByName(both.select(F.col("v").alias("id"))).where("id IS NOT NULL").distinct()
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("entity_id"))


def oldest_first(nodes: DataFrame, order_col: str = "ord") -> DataFrame:
    """Nodes with ``rank``, their age in arrival order; ranks come from sorted partitions' offsets, not from one task."""
    line = Window.partitionBy("__p").orderBy(order_col)
    parts = cut(nodes.repartitionByRange(order_col).withColumn("__p", F.spark_partition_id()))  # cut, as ranges are sampled anew each time
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return parts.withColumn("__r", F.row_number().over(line)).join(F.broadcast(offsets), "__p").withColumn("rank", F.col("__before") + F.col("__r") - 1).drop("__p", "__r", "__before")


