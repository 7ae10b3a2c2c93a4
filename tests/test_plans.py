"""Building, maintaining and searching a knowledge base; the agent; the stream."""

import json
import re
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.resolution import Decision, Resolver, resolve_into, with_signals
from sparkloom.plans import frontends
from sparkloom.plans.agent import Agent, Draft, Hit, Plan, Step, Verdict, neighborhood_text
from sparkloom.plans.corpus import Corpus, Search, agent_tools
from sparkloom.sources import documents, runs
from sparkloom.sources.clients import HashEmbeddings, WordExtraction
from sparkloom.sources.documents import load_documents
from sparkloom.sources.html import write_graph
from sparkloom.sources.protocols import CommittingStore, StoredGraphs
from sparkloom.sources.registry import AuditFile, RegistryFile
from sparkloom.sources.store import SnapshotStore
from sparkloom.streaming.documents import follow


def docs(spark, **texts):
    return spark.createDataFrame([(f"documents/{k}.md", v) for k, v in texts.items()], "source string, markdown string")


@pytest.mark.parametrize("resolved", [False, True])
def test_maintenance(spark, tmp_path, resolved):
    make_resolver = lambda: Resolver(embed=HashEmbeddings().embed, judge=lambda node, candidates: Decision("new"))
    corpus = Corpus(SnapshotStore(spark, str(tmp_path)), WordExtraction(), HashEmbeddings(), make_resolver if resolved else None)
    first = corpus.synchronize(docs(spark, a="Alpha uses Beta.", b="Beta needs Gamma."))
    assert first["added"] == ["documents/a.md", "documents/b.md"]
    assert corpus.errors().isEmpty()
    labels = sorted(r.label for r in corpus.store.load("kb_nodes").collect())
    assert labels == (["Alpha", "Beta", "Gamma"] if resolved else ["Alpha", "Beta", "Beta", "Gamma"])
    again = corpus.synchronize(docs(spark, a="Alpha uses Beta.", b="Beta needs Gamma."))
    assert again["unchanged"] == ["documents/a.md", "documents/b.md"] and not again["changed"]
    then = corpus.synchronize(docs(spark, b="Beta needs Delta.", c="Gamma rests."))
    assert (then["added"], then["changed"], then["deleted"]) == (["documents/c.md"], ["documents/b.md"], ["documents/a.md"])
    assert sorted(r.label for r in corpus.store.load("kb_nodes").collect()) == ["Beta", "Delta", "Gamma"]
    assert corpus.errors().isEmpty()
    assert corpus.store.vacuum() >= 0 and corpus.store.load("chunks").count() == 2


def test_failed_synchronisation_changes_nothing(spark, tmp_path):
    class Broken(WordExtraction):
        def extract(self, text, heading_path):
            raise RuntimeError("no answer")

    store = SnapshotStore(spark, str(tmp_path))
    Corpus(store, WordExtraction()).synchronize(docs(spark, a="Alpha uses Beta."))
    with pytest.raises(Exception, match="no answer"):
        Corpus(store, Broken()).synchronize(docs(spark, a="Alpha uses Gamma."))
    assert sorted(r.label for r in store.load("kb_nodes").collect()) == ["Alpha", "Beta"]


def test_cache_dropped_edges_and_rebuild(spark, tmp_path):
    class Loose(WordExtraction):
        def extract(self, text, heading_path):
            nodes, edges = super().extract(text, heading_path)
            return nodes, [*edges, {"id": "lost", "source_ref": "n0", "target_ref": "nowhere", "label": "to"}]

    class Alike:
        model = "alike"

        def embed(self, texts):
            return [[1.0, 0.0]] * len(texts)

    make = lambda: Resolver(embed=Alike().embed, judge=lambda node, candidates: Decision("merge", next(c.id for c, _ in candidates if c.label == "Beta"), 0.9, ("known as",)) if node.label == "Betta" else Decision("new"))
    corpus = Corpus(SnapshotStore(spark, str(tmp_path)), Loose(), Alike(), make)
    corpus.synchronize(docs(spark, a="Alpha uses Beta. Alphas use Beta.", b="Betta needs Gamma."))
    load = corpus.store.load
    # Within a document Alpha and Alphas are one; across documents the judge decided on Betta.
    assert sorted(r.label for r in load("graph_nodes", source="documents/a.md").collect()) == ["Alpha", "Beta"]
    nodes = {r.label: r for r in load("kb_nodes").collect()}
    assert sorted(nodes) == ["Alpha", "Beta", "Gamma"] and "known as" in next(n.aliases for n in nodes.values() if "Betta" in n.aliases)
    assert {r.edge_id for r in load("dropped_edges").collect()} == {"lost"} and load("dropped_edges").count() == 2 and load("document_counters").count() == 2
    before = {r.id: (r.label, sorted(r.aliases)) for r in nodes.values()}
    corpus.rebuild()
    assert {r.id: (r.label, sorted(r.aliases)) for r in load("kb_nodes").collect()} == before and corpus.errors().isEmpty()
    vectors = {r.id: r for r in load("kb_embeddings").collect()}
    assert set(vectors) == set(before) and load("graph_embeddings", source="documents/b.md").count() == 2
    corpus.synchronize(docs(spark, a="Alpha uses Beta. Alphas use Beta."))
    assert load("extractions").count() == 1 and load("dropped_edges").count() == 2 and load("graph_embeddings").select("source").distinct().count() == 1


def test_documents_see_what_was_known_when_they_began(spark):
    rows = [("x", 0, "s", "h", "x", "Same"), ("a", 1, "t", "h", "a", "Sames"), ("b", 2, "t", "h", "b", "Other"), ("c", 3, "t", "h", "c", "Others"), ("d", 4, "u", "h", "d", "other")]
    frame = spark.createDataFrame([(*r, "tool", None, [], "{}", ["k"], []) for r in rows], "canonical_id string, ord long, source string, content_hash string, node_id string, label string, type string, suggested_type string, aliases array<string>, properties string, chunk_ids array<string>, resolution_aliases array<string>")
    nothing = spark.createDataFrame([], "id string, relations array<string>"), spark.createDataFrame([], "id string, vector array<float>")
    old, new = (with_signals(frame.where(c), *nothing) for c in ("ord = 0", "ord > 0"))
    make = lambda: Resolver(embed=lambda texts: [[1.0]] * len(texts), judge=lambda node, candidates: Decision("new"))
    got = {r.node_id: r.entity_id for r in resolve_into(old, new, make).collect()}
    assert got == {"a": "x", "b": "b", "c": "c", "d": "b"}  # b and c are of one document, which resolves within itself before


def test_node_vectors_seed_unscoped_searches(spark, tmp_path):
    class Marks:
        model = "marks"

        def embed(self, texts):
            return [[1.0, 0.0] if "Quartz" in t or "stone" in t else [0.0, 1.0] for t in texts]

    store = SnapshotStore(spark, str(tmp_path))
    Corpus(store, WordExtraction(), Marks()).synchronize(docs(spark, a="Quartz meets Pyrite.", b="Willow meets Birch."))
    search = Search(store, {"all of it": "documents"}, Marks())
    search.prepare()
    ask = spark.createDataFrame([(1, "which stone")], "query_id int, query string")
    found = search.search(ask)
    ids = {r.id: r.label for r in store.load("kb_nodes").collect()}
    paths = found["paths"].collect()
    assert paths and {ids[i] for p in paths for i in p.node_ids} == {"Quartz", "Pyrite"}  # no word of the query stands in the graph
    assert search.search(ask, scope="all of it")["paths"].isEmpty()
    find, around = agent_tools(search)
    hits = find("which stone", None)
    assert hits and hits[0].source == "documents/a.md" and around(hits[0].source, hits[0].chunk_id) == (None, hits[0], None)
    with pytest.raises(ValueError):
        find(" ", None)


def test_commits_of_two_writers_do_not_overwrite(spark, tmp_path):
    one, two = SnapshotStore(spark, str(tmp_path)), SnapshotStore(spark, str(tmp_path))
    assert isinstance(one, CommittingStore) and one.commit({"chunks": spark.range(1)}) == 1 and two.commit({"chunks": spark.range(2)}) == 2
    with pytest.raises(FileExistsError):
        one._publish(2, "{}")
    assert one.load("chunks").count() == 2 and StoredGraphs(one).store is one


def test_registry_and_audit_files(spark, tmp_path):
    held, audit = RegistryFile(spark, str(tmp_path / "t.json")), AuditFile(spark, str(tmp_path / "a.json"))
    assert held.load_or_default().version == 1 and audit.load() == []
    held.save(held.load_or_default().promoted(["sales_channel"]))
    audit.append([])
    audit.append([{"type": "ä"}])
    audit.append([{"type": "b"}])
    assert held.load().version == 2 and "sales_channel" in held.load().types and audit.load() == [{"type": "ä"}, {"type": "b"}]
    (tmp_path / "t.json").write_text("[]")
    for crc in tmp_path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        held.load()


def test_run_logs_and_settings(tmp_path):
    now = datetime(2024, 1, 2, 3, 4, 5)
    paths = [runs.start_log(tmp_path, keep=2, now=now) for _ in range(3)]
    assert [p.name for p in paths] == ["run-20240102-030405.log", "run-20240102-030405-001.log", "run-20240102-030405-002.log"]
    assert len(list(tmp_path.glob("run-*.log"))) == 2
    runs.LOG.debug("kept")
    assert "DEBUG kept" in max(tmp_path.glob("run-*.log"), key=lambda p: p.stat().st_size).read_text()
    assert runs.Layout("hdfs:///x/").scopes == "hdfs:///x/config/scopes.json"
    settings = runs.Settings.of({"SPARKLOOM_EXTRACTION": "words", "SPARKLOOM_EMBEDDING": "hash"})
    assert [type(c) for c in runs.make_clients(settings)] == [WordExtraction, HashEmbeddings] and settings.embedding_batch == 4
    with pytest.raises(ValueError, match="EMBEDDING is not set.*positive"):
        runs.Settings.of({"SPARKLOOM_EXTRACTION": "words", "SPARKLOOM_EMBEDDING_BATCH": "0"})
    with pytest.raises(ValueError, match="known are: words"):
        runs.make_clients(runs.Settings("other", "hash"))


def test_pdf_checks():
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Pages /Count 2 >> endobj 2 0 obj << /Type /Page >> 3 0 obj << /Type/Page >>\n%%EOF"
    assert documents.pdf_pages(pdf, "s") == 2
    packed = b"%PDF-1.5\n1 0 obj << /Type /ObjStm >> stream\n" + zlib.compress(b"<< /Type /Pages /Kids [] /Count 7 >>") + b"\nendstream\n%%EOF"
    assert documents.pdf_pages(packed, "s") == 7
    for bad, why in ((b"PK", "read"), (pdf.replace(b"%%EOF", b""), "read"), (pdf.replace(b"/Count", b"/Encrypt"), "encrypted"), (b"%PDF-1.4\n%%EOF", "no pages")):
        with pytest.raises(ValueError, match=why):
            documents.pdf_pages(bad, "s")


def test_search(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        Search(store).prepare()
    Corpus(store, WordExtraction(), HashEmbeddings()).synchronize(spark.createDataFrame([("documents/work/a.md", "Alpha uses Beta."), ("documents/home/b.md", "Gamma likes Delta.")], "source string, markdown string"))
    search = Search(store, {"work": "documents/work"}, HashEmbeddings())
    ask = spark.createDataFrame([(1, "Where is Gamma?")], "query_id int, query string")
    with pytest.raises(RuntimeError):
        search.search(ask)
    search.prepare()
    found = search.search(ask)
    best = found["hits"].orderBy("rank").first()
    assert found["hits"].count() >= 1 and search.tables["chunks"].where(F.col("id") == best.id).first().source == "documents/home/b.md"
    assert "Gamma likes Delta." in found["context"].first().context_text
    scoped = search.search(ask, scope=" Work ")
    sources = scoped["references"].select("source").distinct().collect()
    assert all(r.source.startswith("documents/work/") for r in sources)
    with pytest.raises(ValueError, match="unknown scope"):
        search.search(ask, scope="play")


def test_load_documents(spark, tmp_path):
    (tmp_path / "documents/x").mkdir(parents=True)
    (tmp_path / "documents/x/A.MD").write_text("# Ä", encoding="utf-8")
    (tmp_path / "documents/n.txt").write_text("no")
    (tmp_path / "documents/p.pdf").write_bytes(b"pdf")
    with pytest.raises(Exception, match="no converter"):
        load_documents(spark, str(tmp_path / "documents")).collect()
    got = load_documents(spark, str(tmp_path / "documents"), {".pdf": lambda source, content: content.decode() + "!"})
    assert {r.source: r.markdown for r in got.collect()} == {"documents/x/A.MD": "# Ä", "documents/p.pdf": "pdf!"}


def test_html(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "<A>", "tool", None, ["c"], "{}")], "id string, label string, type string, suggested_type string, chunk_ids array<string>, properties string")
    edges = spark.createDataFrame([("e", "a", "a", "self")], "id string, from_id string, to_id string, label string")
    page = write_graph(nodes, edges, tmp_path / "g.html").read_text()
    assert "&lt;" not in page.split("<script")[0].split("title=")[0] and '"label": "<A>"' in page


def test_html_holds_the_whole_graph(spark, tmp_path):
    nodes = spark.range(5100).selectExpr("cast(id AS string) id", "'</n>' label", "'tool' type", "cast(null AS string) suggested_type", "array('c') chunk_ids", "'{}' properties")
    edges = spark.range(50500).selectExpr("concat('e', id) id", "cast(id % 5100 AS string) from_id", "cast(id * 7 % 5100 AS string) to_id", "'uses' label")
    page = write_graph(nodes, edges, tmp_path / "g.html").read_text(encoding="utf-8")
    graph = json.loads(re.search(r'id="graph">(.*?)</script>', page, re.S)[1])
    assert len({n["id"] for n in graph["nodes"]}) == len(graph["nodes"]) == page.count("<li ") == 5100 and graph["nodes"][0]["label"] == "</n>"
    assert len({e["id"] for e in graph["edges"]}) == len(graph["edges"]) == 50500


class Script:
    """A model that answers from lists."""

    def __init__(self, plan, steps, verdicts, drafts):
        self.plan, self.steps, self.verdicts, self.drafts, self.corrections = plan, list(steps), list(verdicts), list(drafts), 0

    def decompose(self, prompt):
        return self.plan

    def research(self, prompt, correction):
        self.corrections += correction
        return self.steps.pop(0)

    def evaluate(self, prompt):
        return self.verdicts.pop(0)

    def answer(self, prompt):
        return self.drafts.pop(0)

    def summarize(self, prompt):
        return "summary"


def agent(model, hits=(Hit("a.md", "c1", "text", 1, 2),)):
    return Agent(model, lambda query, scope: list(hits), lambda source, chunk: (None, Hit(source, chunk, "own"), None), {"work": "documents/work"})


SEARCH = Step("search", {"query": "q"})


def test_agent_answers_with_citations():
    model = Script(Plan(["one", " one ", "two"]), [SEARCH, SEARCH], [Verdict("sufficient")] * 2, [Draft("x", ["S9"]), Draft("yes", ["S1", "S1"])])
    got = agent(model).ask("why?", "t")
    assert (got.text, got.status, got.references, got.searches) == ("yes", "complete", [("a.md", 1, 2)], 2)


def test_agent_budgets_and_gaps():
    model = Script(Plan(["one"]), [SEARCH] * 3, [Verdict("insufficient", "price of alpha"), Verdict("insufficient", "colour of beta"), Verdict("insufficient", "weight of gamma")], [Draft("partly", ["S1"])])
    assert agent(model).ask("why?", "t").status == "partial" and not model.steps
    model = Script(Plan(["one"]), [SEARCH] * 3, [Verdict("insufficient", "the price of alpha")] * 3, [Draft("partly", ["S1"])])
    agent(model).ask("why?", "t")
    assert len(model.steps) == 1  # stopped, as the gap stayed


def test_agent_needs_citations_and_evidence():
    model = Script(Plan(["one"]), [SEARCH], [Verdict("sufficient")], [Draft("bare", [])])
    with pytest.raises(RuntimeError, match="cites none"):
        agent(model).ask("why?", "t")
    model = Script(Plan(["one"]), [SEARCH] * 3, [Verdict("sufficient")] * 3, [Draft("guess", [])])
    got = agent(model, hits=()).ask("why?", "t")
    assert got.status == "partial" and got.text.endswith("guess")


def test_agent_conversation_scope_and_memory():
    model = Script(Plan(["hello"]), [Step(text="Hi!")], [Verdict("conversation")], [])
    a = agent(model)
    assert a.ask("hello", "t").text == "Hi!" and len(a.memory["t"]) == 2
    a.reset("t")
    assert "t" not in a.memory
    with pytest.raises(ValueError):
        a.reset(" ")
    model = Script(Plan(["x"], scope="play"), [], [], [])
    assert "work" in agent(model).ask("x", "t").text
    with pytest.raises(ValueError):
        Plan([" "])


def test_front_ends():
    said, signs = [], []
    make = lambda: agent(Script(Plan(["one"]), [SEARCH], [Verdict("sufficient")], [Draft("yes", ["S1"])]))
    chat = frontends.Chat(make(), lambda c, t: said.append((c, t)), signs.append, frozenset({7}), every=0.01)
    assert not chat.handle(8, 1, "why?") and chat.handle(7, 1, "why?", group=True) and signs[0] == 7
    assert said == [(7, "yes\n\nSources:\n[1] a.md (pp. 1-2)")] and "chat:7:user:1" in chat.agent.memory
    chat.handle(7, 1, "/reset", group=True)
    assert "chat:7:user:1" not in chat.agent.memory and chat.handle(7, 1, "/help") and said[-1] == (7, frontends.GREETING)
    broken = frontends.Chat(agent(Script(Plan(["one"]), [SEARCH], [Verdict("sufficient")], [Draft("bare", [])])), lambda c, t: said.append(t), signs.append, frozenset({7}))
    assert broken.handle(7, 1, "why?") and said[-1] == frontends.SORRY
    lines = []
    assert frontends.terminal(make(), ["", "why?", "/reset"], lines.append) == 1 and lines[0].startswith("yes") and lines[1] == "Forgotten."


def test_neighborhood_text():
    assert neighborhood_text(None, Hit("s", "c", "t", 1, 2, ("H",)), None) == "Previous chunk: [None]\n\nCurrent chunk [c | s | pages 1-2 | H]\nt\n\nNext chunk: [None]"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "old", False, 1), ("a", "new", False, 2), ("b", "x", True, 1)], "source string, markdown string, deleted boolean, ts int")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "in"))
    seen = []
    follow(stream, lambda new, gone: seen.append((new.collect(), gone.collect())), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.source, r.markdown) for r in seen[0][0]] == [("a", "new")] and [r.source for r in seen[0][1]] == ["b"]
