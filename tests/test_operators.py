"""Operators on small literal fixtures."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import chunking, provenance, resolution, retrieval, scoring, taxonomy
from sparkloom.sources import documents, scopes

NODE = "id string, label string, type string, suggested_type string, aliases array<string>, properties string, chunk_ids array<string>"
EDGE = "id string, from_id string, to_id string, label string, properties string, chunk_ids array<string>"
CHUNK = "id string, source string, `index` int, text string, heading_path array<string>, page_start int, page_end int"


def chain(spark):
    chunks = [("alpha-beta", "d.md", 0, "Alpha uses Beta.", [], None, None), ("beta-gamma", "d.md", 1, "Beta depends on Gamma.", [], None, None), ("beta-company", "d.md", 2, "Beta was created by Example Corp.", [], None, None)]
    nodes = [("alpha", "Alpha", "tool", None, [], "{}", ["alpha-beta"]), ("beta", "Beta", "tool", None, [], "{}", ["alpha-beta", "beta-gamma", "missing"]), ("gamma", "Gamma", "tool", None, ["Third"], "{}", ["beta-gamma"]), ("company", "Example Corp", "organization", None, [], '{"a": 1}', ["beta-company"])]
    edges = [("e1", "alpha", "beta", "uses", "{}", ["alpha-beta"]), ("e2", "beta", "gamma", "depends on", "{}", ["beta-gamma"]), ("e3", "beta", "company", "created by", "{}", ["beta-company"])]
    return spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_normalisation(spark):
    s = spark.createDataFrame([(1, "a", 0.82), (1, "b", 0.74), (1, "c", 0.65), (2, "a", 0.5), (3, "a", 0.4), (3, "b", 0.4)], "query_id int, id string, score double")
    got = {(r.query_id, r.id): round(r.score, 3) for r in scoring.normalize_min_max(s).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.529, (1, "c"): 0.0, (2, "a"): 1.0, (3, "a"): 1.0, (3, "b"): 1.0}
    assert scoring.normalize_max(s.where("score > 9")).count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "x", 2)], "query_id int, id string, rank int")
    got = {r.id: (round(r.score, 9), r.best_rank) for r in scoring.fuse_ranks([a, b]).collect()}
    assert got == {"x": (round(1 / 61 + 1 / 62, 9), 1), "y": (round(1 / 62, 9), 2), "z": (round(1 / 61, 9), 1)}


def test_graph_search_finds_the_chain(spark):
    chunks, nodes, edges = chain(spark)
    g = retrieval.graph_retriever(chunks, nodes, edges)
    ask = spark.createDataFrame([(1, "How does Alpha relate to Gamma?"), (2, "nothing at all")], "query_id int, query string")
    paths = g.best_paths(ask).orderBy("query_id", "rank").collect()
    assert {p.query_id for p in paths} == {1}
    assert sorted(paths[0].node_ids) == ["alpha", "beta", "gamma"]
    assert paths[0].score == 1.0
    text = retrieval.path_lines(g.best_paths(ask), nodes, edges).where("rank = 1").first().line
    assert text in ("Alpha --uses--> Beta --depends on--> Gamma", "Gamma <--depends on-- Beta <--uses-- Alpha")
    hits = g.rank(g.best_paths(ask)).orderBy("rank").collect()
    assert {h.id for h in hits} == {"alpha-beta", "beta-gamma", "beta-company"}


def test_chunk_search_and_context(spark):
    chunks, nodes, edges = chain(spark)
    ask = spark.createDataFrame([(1, "gamma")], "query_id int, query string")
    hits = retrieval.chunk_retriever(chunks, nodes, edges).rank(ask)
    assert hits.orderBy("rank").first().id == "beta-gamma"
    text = retrieval.context_text(ask, hits, chunks, retrieval.annotations(chunks, nodes, edges)).first().context_text
    assert text.startswith("Query: gamma\n\nEvidence:\n[beta-gamma | d.md]\nBeta depends on Gamma.\nLinked entities:\n- Beta [tool]\n- Gamma [tool] | aliases: Third")
    assert "Linked relationships:\n- Beta --depends on--> Gamma" in text
    none = retrieval.context_text(ask, hits.where("false"), chunks, retrieval.annotations(chunks, nodes, edges)).first().context_text
    assert none == "Query: gamma\n\nEvidence:\n- None"


def test_mentions_prefer_the_longest(spark):
    nodes = spark.createDataFrame([("a", "Open", []), ("b", "Open AI", []), ("c", "x", ["AI lab"])], "id string, label string, aliases array<string>")
    ask = spark.createDataFrame([(1, "the open AI, lab and open"), (2, "open ai")], "query_id int, query string")
    assert {(r.query_id, r.id) for r in retrieval.mentions(ask, nodes).collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "b")}


def test_limits():
    with pytest.raises(ValueError, match="max_hops"):
        retrieval.check_limits(0, 1, 1)


def test_sections_and_packing():
    got = chunking.chunk_markdown("intro\n# A\ntext one\n## B\ntext two\n<!-- sparkloom:page=3 -->\nlater\n# C\n---", target=1, most=100)
    assert [(c.text, c.path, c.first) for c in got] == [("intro", [], None), ("# A\ntext one", ["A"], None), ("## B\ntext two", ["A", "B"], None), ("later", ["A", "B"], 3), ("# C\n---", ["C"], 3)]
    merged = chunking.chunk_markdown("# A\none\n## B\ntwo\n## C\nthree")
    assert [(c.text, c.path) for c in merged] == [("# A\none\n\n## B\ntwo\n\n## C\nthree", ["A"])]
    long = chunking.chunk_markdown(" ".join(["word"] * 50), count=lambda t: len(t.split()), target=10, most=20)
    assert [len(c.text.split()) for c in long] == [20, 20, 10]
    assert chunking.chunk_markdown("!!!\n\n---") == []
    hard = chunking.chunk_markdown("x" * 25, count=len, target=5, most=10)
    assert [len(c.text) for c in hard] == [10, 10, 5]


def test_neighbors_of_unknown_chunk(spark):
    chunks, *_ = chain(spark)
    assert [(r.id, r.place) for r in chunking.neighbors(chunks, "d.md", "beta-gamma").orderBy("place").collect()] == [("alpha-beta", -1), ("beta-gamma", 0), ("beta-company", 1)]
    with pytest.raises(ValueError, match="unknown"):
        chunking.neighbors(chunks, "d.md", "nope")


def entity(i, label, kind="tool", source="s", **more):
    return resolution.Entity(i, (resolution.Contribution(source, "h", i, label, kind, **more),))


def resolver(judge=None, vectors=None):
    known = vectors or {}
    return resolution.Resolver(embed=lambda texts: [next((v for k, v in known.items() if f"label: {k}\n" in t), [0.0, 1.0]) for t in texts], judge=judge or (lambda n, c: resolution.Decision("new")))


def test_names_merge_without_a_judge():
    def never(*_):
        raise AssertionError

    r = resolver(never)
    ids = r.combine([(("s", "h"), [entity("a", "OpenAI organization", "organization", aliases=("OpenAI",)), entity("b", "openai", "Organization")])], within=True)
    assert ids == {"a": "a", "b": "a"}
    assert r.entities["a"].aliases == ("OpenAI",)


def test_judge_decides_and_ties_go_by_id():
    seen = []

    def judge(node, candidates):
        seen.append([c.id for c, _ in candidates])
        return resolution.Decision("merge", "a", 0.9, ("extra",))

    r = resolver(judge)
    r.top_k = 2
    r.start([entity("c", "One"), entity("a", "Two"), entity("b", "Three")])
    assert r.add(entity("n", "Four"), None, ("t", "h")) == "a"
    assert seen == [["a", "b"]]
    assert r.entities["a"].aliases == ("Four", "extra")
    unsure = resolver(lambda n, c: resolution.Decision("merge", "a", 0.5))
    unsure.start([entity("a", "Two")])
    assert unsure.add(entity("n", "Four"), None, ("t", "h")) == "n"


def test_frozen_candidates_and_clashing_ids():
    r = resolver()
    ids = r.combine([(("s", "h"), [entity("a", "Same"), entity("b", "Same")])], within=False)
    assert ids == {"a": "a", "b": "b"}
    assert r.add(entity("a", "Other", source="t"), None, ("t", "x")) == "a::0002"
    r.min_similarity = 1.1
    assert r.near(entity("z", "Same"), ["a", "b"]) == []


def test_type_follows_the_first_classified():
    e = resolution.Entity("a", (resolution.Contribution("s", "h", "a", "Widget", "Unclassified", suggested_type="sensor"), resolution.Contribution("t", "h", "b", "Widgets", "tool", aliases=("Y", "widget"))))
    assert (e.type, e.suggested_type, e.aliases) == ("tool", "sensor", ("Y",))


def test_edge_ids_are_kept_or_given(spark):
    rows = spark.createDataFrame([(1, "edge-0002"), (2, "x"), (3, "x"), (4, "edge-0001"), (5, "x")], "key_ord long, edge_id string")
    assert [r.new_id for r in provenance.allocate_edge_ids(rows).orderBy("key_ord").collect()] == ["edge-0002", "x", "edge-0001", "edge-0003", "edge-0004"]


def test_connected_entities(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "id string, match_id string")
    assert {r.id: r.entity_id for r in resolution.connected_entities(pairs).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_oldest_first(spark):
    rows = resolution.oldest_first(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "ord long"))
    assert all(r.ord == r["rank"] for r in rows.collect())


def test_promotion(spark):
    rows = [("Sales Channel", "sales_channel", f"n{i}", "n", "unclassified", f"s{i % 2}", "c", None, i) for i in range(5)] + [("rare", "rare", "n9", "n", "unclassified", "s1", "c", None, 9)]
    s = spark.createDataFrame(rows, "suggested_type string, normalized string, node_id string, node_label string, current_type string, source string, chunk_id string, created_at timestamp, ord long")
    nodes = spark.createDataFrame([("n0", 0, "s0", "Unclassified", "sales channel"), ("n1", 1, "s1", "tool", "sales channel")], "id string, ord long, source string, type string, suggested_type string")
    registry, migrated, promotions = taxonomy.evolve(taxonomy.Registry(), s, nodes)
    assert registry.version == 2 and "sales_channel" in registry.types
    assert {(r.id, r.type, r.suggested_type) for r in migrated.collect()} == {("n0", "sales_channel", None), ("n1", "tool", "sales channel")}
    assert [(r.normalized, r.affected) for r in promotions.collect()] == [("sales_channel", ["s0:n0"])]


def test_overlap_is_removed():
    assert documents.without_overlap("we talk about the new product line today", "about the new product line today and tomorrow") == "and tomorrow"
    assert documents.without_overlap("one two three", "four five six") == "four five six"
    assert documents.without_overlap(None, "  x ") == "x"
    noisy = documents.without_overlap("so the quarterly numbers look really good this time", "The quarterly numbers look very good this time. Next item")
    assert noisy == "Next item"


def test_windows_batches_and_pages(spark):
    def windows(ms):
        return [tuple(w) for w in spark.range(1).select(documents.audio_windows(F.lit(ms)).alias("w")).first().w]

    assert windows(1_203_000) == [(0, 1_203_000)]
    assert windows(2_403_000) == [(0, 1_205_000), (1_200_000, 2_403_000)]
    assert [[n for n, _ in b] for b in documents.page_batches(["a", "b", "c" * 20_000, "d", "e"])] == [[1, 2], [3], [4, 5]]
    with pytest.raises(ValueError, match="expected pages"):
        documents.checked_pages([1, 2], [(1, "a", False)], "s")
    with pytest.raises(ValueError, match="empty"):
        documents.checked_pages([1], [(1, " ", False)], "s")
    assert documents.page_markdown([(1, "a"), (2, "")]) == "<!-- sparkloom:page=1 -->\n\na\n\n<!-- sparkloom:page=2 -->\n"
    frame = spark.createDataFrame([("s", i + 1, n) for i, n in enumerate([1, 1, 20_000, 1, 1])], "source string, page int, n_chars long")
    assert [r.batch for r in documents.page_batch_frame(frame).orderBy("page").collect()] == [1, 1, 2, 3, 3]


@pytest.mark.parametrize("bad", ["[]", '{"all": "documents/x"}', '{"a": "elsewhere"}', '{"a": "documents/../x"}', '{"a": "documents/x", " A ": "documents/y"}', '{"": "documents/x"}', "{"])
def test_bad_scopes(bad):
    with pytest.raises(scopes.ScopeError):
        scopes.parse_scopes(bad)


def test_scopes():
    assert scopes.parse_scopes('{" Work ": "documents\\\\work/"}') == {"work": "documents/work"}


def test_long_chains_are_one_entity(spark):
    pairs = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(90)] + [("y", "y")], "id string, match_id string")
    assert {r.id: r.entity_id for r in resolution.connected_entities(pairs).collect()} == {f"n{k:03}": "n000" for k in range(91)} | {"y": "y"}
    with pytest.raises(RuntimeError):
        resolution.connected_entities(pairs, rounds=1)
