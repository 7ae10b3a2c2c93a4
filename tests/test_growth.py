"""What grows with the input: sizes of intermediate tables, ties and precision that only larger tables show."""

from pathlib import Path

from pyspark.sql import functions as F

from sparkloom.operators import retrieval

NODE = "id string, label string, type string, suggested_type string, aliases array<string>, properties string, chunk_ids array<string>"
EDGE = "id string, from_id string, to_id string, label string, properties string, chunk_ids array<string>"
CHUNK = "id string, source string, `index` int, text string, heading_path array<string>, page_start int, page_end int"


def written(spark) -> int:
    place = spark.sparkContext._jsc.sc().getCheckpointDir()
    return sum(f.stat().st_size for f in Path(place.get().removeprefix("file:")).rglob("*") if f.is_file()) if place.isDefined() else 0


def test_paths_do_not_carry_the_texts_of_their_evidence(spark):
    chunks = [(f"c{i}", "d.md", i, "alpha " + f"word{i} " * 200, [], None, None) for i in range(100)]
    nodes = [("hub", "Alpha", "tool", None, [], "{}", [c[0] for c in chunks]), *((f"s{i}", f"Spoke {i}", "tool", None, [], "{}", []) for i in range(40))]
    edges = [(f"e{i}", f"s{i}", "hub", "meets", "{}", ["c7", "c3", "c7"] if i == 5 else []) for i in range(40)]
    g = retrieval.graph_retriever(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))
    before = written(spark)
    paths = g.best_paths(spark.createDataFrame([(1, "alpha spoke 5")], "query_id int, query string")).collect()
    size = sum(len(c[3]) for c in chunks)
    assert written(spark) - before < 10 * size  # 40 paths meet all of the hub's chunks
    by_edges = {tuple(p.edge_ids): p.chunk_ids for p in paths}
    assert by_edges.pop(("e5",)) == ["c7", "c3"]
    assert all(c in (["c7", "c3"], [x[0] for x in chunks]) for c in by_edges.values())


def test_names_that_all_nodes_share_do_not_pair_them(spark):
    from sparkloom.operators import resolution

    p = spark.range(3000).select("id", F.lit("Same Names").alias("label"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("id") % 3 == 0, "unclassified").when(F.col("id") % 3 == 1, "Tool").otherwise("x").alias("type"), (3000 - F.col("id")).alias("rank"))
    got = resolution.name_matches(p, p)
    assert {(r.k, r.match_id): r.n for r in got.groupBy((F.col("id") % 3).alias("k"), "match_id").agg(F.count("*").alias("n")).collect()} == {(0, 2999): 1000, (1, 2998): 1000, (2, 2999): 1000}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3  # the canonical side has one row for each name and type


def test_cosines_of_keys_lengths_and_nulls(spark):
    from sparkloom.operators import scoring

    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 1.0]), (3, "b", [1.0, 0.0]), (4, "a", [0.0, 0.0]), (5, "a", [1.0]), (6, None, [1.0, 0.0]), (7, "a", None), (8, "a", [1.0, None]), (9, "a", [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, label string, vector array<float>")
    ask = v.where("id IN (1, 5)").withColumnRenamed("id", "query_id")
    all_pairs = {(r.query_id, r.id): round(r.score, 6) for r in scoring.cosine_pairs(ask, v, "label").collect()}
    assert all_pairs[1, 2] == 0.707107 and all_pairs[1, 9] == -1 and all_pairs[1, 5] == 0 and all_pairs[1, 4] == 0 and all_pairs[1, 8] == 0
    assert {i for q, i in all_pairs if q == 1} == {1, 2, 4, 5, 8, 9}
    got = {(r.query_id, r.id): round(r.score, 6) for r in scoring.semantic_scores(ask, v).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): 1.0, (1, 6): 1.0, (5, 5): 1.0}
    assert "MapInArrow" in scoring.semantic_scores(ask, v)._jdf.queryExecution().toString()


def test_edges_that_begin_at_one_place_stay_apart(spark):
    from sparkloom.operators import provenance

    edge = "canonical_id string, ord long, source string, content_hash string, edge_id string, from_id string, to_id string, label string, properties string, chunk_ids array<string>"
    row = lambda o, i, a, b: (i, o, "d", "h", i, a, b, "x", "{}", ["c"])
    edges = spark.createDataFrame([row(1, "p", "a", "b"), row(1, "p", "c", "d"), row(1, "p", "c", "d"), row(2, "q", "a", "b")], edge)
    grouped = provenance.group_edges(edges)
    key = ["first_ord", "from_id", "to_id", "label"]
    assert grouped.select(*key).distinct().count() == 2
    node = "canonical_id string, ord long, source string, content_hash string, node_id string, label string, type string, suggested_type string, aliases array<string>, properties string, chunk_ids array<string>, resolution_aliases array<string>"
    _, out = provenance.combine_graphs(spark.createDataFrame([], node), edges)
    assert sorted((r.id, r.from_id, r.to_id, r.n_provenance) for r in out.collect()) == [("edge-0001", "c", "d", 2), ("p", "a", "b", 2)]


def test_similarities_have_double_precision(spark):
    from sparkloom.operators import resolution

    near = [float(x) for x in range(1, 65)]
    v = spark.createDataFrame([(1, 0, near), (2, 0, [1.0, *near[1:63], 64.0001]), (3, 0, near), (4, 0, near)], "id long, block int, vector array<double>")
    got = {(r.id, r.match_id): (r.similarity, r.place) for r in resolution.similar_in_blocks(v, v, min_similarity=0.2).collect()}
    assert got[1, 3] == (1.0, 1) and got[1, 4] == (1.0, 2)
    assert 0 < 1 - got[1, 2][0] < 1e-11 and got[1, 2][1] == 3  # single precision calls these equal


def test_page_batches_stream_and_unknown_lengths_stand_alone(spark):
    from sparkloom.sources import documents

    rows = [("a", i, n) for i, n in enumerate([9000, 7000, 1, None, 5, 6], 1)] + [("b", 1, 20_000), ("b", 2, 1), (None, 1, 3)]
    got = documents.page_batch_frame(spark.createDataFrame(rows, "source string, page int, n_chars long"))
    assert sorted((r.source or "", r.page, r.batch) for r in got.collect()) == [("", 1, 1), ("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("a", 5, 4), ("a", 6, 4), ("b", 1, 1), ("b", 2, 2)]


def test_merging_costs_what_it_adds(spark, monkeypatch):
    from sparkloom.operators import resolution

    calls = []
    plain = resolution.plain_name
    monkeypatch.setattr(resolution, "plain_name", lambda text: calls.append(1) or plain(text))
    one = lambda i: resolution.Entity(f"p{i}", (resolution.Contribution("s", "h", f"p{i}", "Red bolts" if i % 2 else "red bolt", "tool"),))
    r = resolution.Resolver(embed=lambda texts: [[1.0]] * len(texts), judge=lambda node, candidates: resolution.Decision("new"))
    early = one(0)
    assert r.add(early) == "p0"
    assert all(r.add(one(i)) == "p0" for i in range(1, 300))
    assert len(calls) < 10 * 300
    assert len(r.entities["p0"].parts) == 300 and len(early.parts) == 1 and r.entities["p0"].aliases == ()
    fork = early.grown((resolution.Contribution("t", "h", "x", "Other", "Unclassified", aliases=("Third",)),))
    assert [p.label for p in fork.parts] == ["red bolt", "Other"] and fork.aliases == ("Other", "Third") and len(r.entities["p0"].parts) == 300


def test_long_documents_come_back_in_small_batches(spark):
    from sparkloom.functions import text
    from sparkloom.operators import chunking

    d = spark.createDataFrame([(i, "word " * 100_000 if i % 5 else None) for i in range(20)], "doc_id long, text string").coalesce(1)
    parts = text.message_rows(d, "doc_id", "text")
    assert parts.count() == d.select(F.posexplode(text.split_messages("text"))).count()
    assert "MapInArrow" in parts._jdf.queryExecution().toString()
    chunks = chunking.chunk_documents(d.select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("markdown")), target=1, most=60)
    assert "MapInArrow" in chunks._jdf.queryExecution().toString() and chunks.select("source").distinct().count() == 16


def test_two_hops_are_made_once_and_as_unique_paths_keeps_them(spark):
    edges = [("e1", "hub", "a"), ("e2", "b", "hub"), ("e3", "hub", "c"), ("e4", "a", "hub"), ("e5", "c", "d")]
    adj = retrieval.adjacency(spark.createDataFrame(edges, "id string, from_id string, to_id string"))
    one = adj.select(F.lit(1).alias("query_id"), F.array("node", "neighbor").alias("node_ids"), F.array("edge_id").alias("edge_ids"), F.lit(1.0).alias("seed_score"))
    two = one.withColumn("node", F.element_at("node_ids", -1)).join(adj, "node").where(~F.array_contains("node_ids", F.col("neighbor")))
    two = two.select("query_id", F.concat("node_ids", F.array("neighbor")).alias("node_ids"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), "seed_score")
    rows = lambda df: sorted((r.node_ids, r.edge_ids) for r in df.collect())
    assert rows(retrieval.two_hops(adj)) == rows(retrieval.unique_paths(two)) and len(rows(two)) == 2 * len(rows(retrieval.two_hops(adj)))


def test_turns_keep_words_that_the_turn_before_ends_with(spark, tmp_path):
    import duckdb

    from sparkloom.plans.queries import QUERIES, SQL

    rows = [(1, 0, "so it was one two three four five"), (1, 1, "One two three four five, and on"), (2, 0, " spaced \n"), (2, 1, ""), (2, 2, None), (2, 10, "end  "), (3, 0, None), (4, 400, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["transcripts"](spark, str(tmp_path)).select("source", "markdown").collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(SQL["transcripts"]).fetchall())
    assert "One two three" in next(r.markdown for r in got if r.source == "talks/1.mp3")


def test_page_ranges_sort_once_in_tasks_that_do_not_grow(spark):
    hits = [(1, "a", 2, 3, 1), (1, "a", 4, 4, 2), (1, "a", 9, 9, 3), (1, "a", 2, 3, 1), (1, "b", None, None, 5), (1, "b", 1, 2, 4), (2, "a", 5, 9, 7), (2, "a", 6, 6, 8), (2, "a", 10, 1, 9), (2, "a", 12, 12, 6)]
    df = spark.createDataFrame(hits, "query_id int, source string, page_start int, page_end int, rank int")
    want = [(1, "a", 2, 4, 1), (1, "a", 9, 9, 1), (1, "b", None, None, 4), (2, "a", 5, 9, 6), (2, "a", 12, 12, 6)]
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(retrieval.page_ranges(df)) == order(retrieval.page_ranges(df, 10_000_000)) == sorted(want, key=str)
    plan = retrieval.page_ranges(df, 10_000_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and ", 51), REPARTITION_BY_NUM" in plan


def test_edges_of_few_sources_stay_where_they_are(spark, tmp_path, monkeypatch):
    from sparkloom.operators import sync

    n = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s1"), ("c", "s3"), (None, "s1"), ("d", None)], "canonical_id string, source string")
    spark.createDataFrame([("e1", "s9", "a", "b"), ("e2", "s9", "b", "c"), ("e3", "s1", "b", "b"), ("e4", "s9", "b", "d"), ("e4", None, None, None), ("e1", None, "c", "a"), ("e5", None, None, "c")], "canonical_id string, source string, from_id string, to_id string").write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    sources = spark.createDataFrame([("s1",), ("s1",), (None,)], "source string")
    for most in (250_000, 0):
        monkeypatch.setattr(sync, "BROADCAST_KEYS", most)
        nodes, edges = sync.affected_ids(n, e, sources)
        assert {r[0] for r in nodes.collect()} == {"a", "c", None} and nodes.count() == 3
        assert sorted(r[0] for r in edges.collect()) == ["e1", "e2", "e3", "e5"]
        plans = edges._jdf.queryExecution()
        assert plans.optimizedPlan().toString().count("Relation [") == 1 and plans.executedPlan().toString().count("BroadcastHashJoin") >= (3 if most else 0)


def test_words_of_normal_forms_are_made_once(spark, tmp_path):
    import duckdb

    from sparkloom.functions import text
    from sparkloom.plans.queries import QUERIES, SQL

    # The cheap looks before the folds must find every one of them, alone and with others.
    texts = [f"Axes{c}Ties x" for c in text.CASE_FOLDS] + ["".join(text.CASE_FOLDS), "λ 中 Companies“classes”", "", None, "ß", "ŉßẚ Boxes"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["normal_forms"](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = db.sql(f"SELECT doc_id, normal, type, name, content FROM ({SQL['normal_forms']})").fetchall()
    assert sorted(map(tuple, df.select("doc_id", "normal", "type", "name", "content").collect())) == sorted(expected)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert "[ßẞ" not in text.fold(F.col("text"))._jc.toString()
