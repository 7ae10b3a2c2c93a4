"""Further queries: chunking step by step, stores and files there and back, conversion, resolution, maintenance and the agent.

What needs files writes them to a folder of its own in the shared place and removes it once its rows are cut.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.lineage import cut, remove, shared_dir
from sparkloom.operators import chunking, graph_build, resolution, retrieval, taxonomy
from sparkloom.plans import agent
from sparkloom.plans import tables as T
from sparkloom.plans.corpus import Corpus
from sparkloom.plans.queries import CAPITALS, SUGGEST, query, sql_name, sql_type
from sparkloom.sources import clients, documents, registry, scopes, store


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"


def _kept(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    out = cut(rows)
    remove(spark, folder)
    return out


# --- chunking, step by step -----------------------------------------------------------------------------------------------

SQL_COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{Nl}}\p{{No}}]{{1,6}}|\p{{Nd}}{{1,3}}|[^\p{{L}}\p{{N}}_\s]|_'))"
SQL_KEY = "conv_id || '-' || left(sha256('talks/' || conv_id || '.md'), 8) || '-chunk-' || lpad(i::VARCHAR, 4, '0')"
TURNS = """tu AS (SELECT conv_id, 0 i, '# Conversation ' || conv_id body, NULL::VARCHAR role, NULL::INT page FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT, '## ' || role || chr(10) || chr(10) || regexp_replace(text, '\\s+$', ''), role, (turn + 1)::INT FROM conversations)"""


def _talks(spark: SparkSession, sf_dir: str, pages: bool) -> DataFrame:
    """Conversations as Markdown: a heading, and a section for each turn, on a page of its own if wanted."""
    page = F.concat(F.lit("<!-- sparkloom:page="), F.col("turn") + 1, F.lit(" -->\n")) if pages else F.lit("")
    part = F.concat(page, F.lit("## "), "role", F.lit("\n\n"), "text")
    c = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["p"]), "\n\n")
    return c.select(F.concat(F.lit("talks/"), "conv_id", F.lit(".md")).alias("source"), F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n"), body).alias("markdown"))


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "source", "index", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join("heading_path", " > ").alias("heading"), "page_start", "page_end")


@query(f"""WITH {TURNS} SELECT {SQL_KEY} id, 'talks/' || conv_id || '.md' AS source, i AS index, md5(body) digest, 'Conversation ' || conv_id || coalesce(' > ' || role, '') heading, page page_start, page page_end FROM tu""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by heading and page, neither cut nor packed."""
    return _chunk_rows(chunking.chunk_documents(_talks(spark, sf_dir, True), target=1, most=10**9))


@query(f"""WITH RECURSIVE {TURNS}, n AS (SELECT *, {SQL_COUNT.format('body')} k FROM tu),
 p AS (SELECT conv_id, i, 0 chunk, k tokens FROM n WHERE i = 0 UNION ALL SELECT n.conv_id, n.i, CASE WHEN p.tokens < 400 AND p.tokens + n.k <= 900 THEN chunk ELSE chunk + 1 END, CASE WHEN p.tokens < 400 AND p.tokens + n.k <= 900 THEN p.tokens + n.k ELSE n.k END FROM p JOIN n ON n.conv_id = p.conv_id AND n.i = p.i + 1),
 g AS (SELECT conv_id, chunk AS i, string_agg(body, chr(10) || chr(10) ORDER BY n.i) b, bool_or(role IS NULL) OR count(DISTINCT role) > 1 mixed, any_value(role) role FROM p JOIN n USING (conv_id, i) GROUP BY conv_id, chunk)
 SELECT {SQL_KEY} id, 'talks/' || conv_id || '.md' AS source, i AS index, md5(b) digest, 'Conversation ' || conv_id || CASE WHEN mixed THEN '' ELSE ' > ' || role END heading, NULL::INT page_start, NULL::INT page_end FROM g""")  # fmt: skip
def packed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sections packed while short."""
    return _chunk_rows(chunking.chunk_documents(_talks(spark, sf_dir, False), target=400, most=900))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) b FROM documents), pc AS (SELECT doc_id, unnest(ps) x, generate_subscripts(ps, 1) k FROM (SELECT doc_id, regexp_extract_all(b, '\s+|[\p{L}\p{Nl}\p{No}]{1,6}|\p{Nd}{1,3}|[^\p{L}\p{N}_\s]|_') ps FROM d)),
 po AS (SELECT doc_id, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(x) s FROM pc), tk AS (SELECT doc_id, s::INT s, row_number() OVER (PARTITION BY doc_id ORDER BY s) t FROM po WHERE NOT regexp_matches(x, '^\s')),
 r AS (SELECT doc_id, 0 pos, -1 part, NULL::VARCHAR piece FROM d WHERE b <> '' UNION ALL
 SELECT doc_id, CASE WHEN low IS NULL THEN length(b) ELSE pos + cut + length(regexp_extract(substr(b, pos + cut + 1), '^\s*')) END, part + 1, CASE WHEN low IS NULL THEN substr(b, pos + 1) ELSE regexp_replace(substr(b, pos + 1, cut), '\s+$', '') END FROM
 (SELECT *, CASE WHEN gap >= greatest(1, low // 2) THEN gap ELSE low END cut FROM (SELECT *, length(regexp_extract(substr(b, pos + 1, low + 1), '(?s)^(.*\S)\s+\S*$', 1)) gap FROM
 (SELECT r.doc_id, r.pos, r.part, d.b, y.s - r.pos low FROM r JOIN d USING (doc_id) JOIN tk x ON x.doc_id = r.doc_id AND x.s = r.pos LEFT JOIN tk y ON y.doc_id = r.doc_id AND y.t = x.t + 60 WHERE r.pos < length(d.b)))))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 part, md5(piece) digest FROM r WHERE part >= 0 AND regexp_matches(piece, '[\p{L}\p{N}]')""")  # fmt: skip
def cut_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long paragraphs cut at white space near their sixtieth token."""
    d = T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("markdown"))
    out = chunking.chunk_documents(d, target=1, most=60)
    return out.select(F.col("source").cast("long").alias("doc_id"), F.col("index").cast("long").alias("part"), F.md5(F.col("text").cast("binary")).alias("digest"))


# --- speech -----------------------------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT 'u' || user_id u, 'w' || event_id w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 k FROM events), z AS (SELECT *, count(*) OVER (PARTITION BY u) n FROM k),
 b AS (SELECT u, CASE WHEN k < 12 THEN 0 ELSE k // 6 - 1 END win, k, w FROM z UNION ALL SELECT u, (n - 1) // 6, k, w FROM z WHERE n > 6 AND k >= (n - 1) // 6 * 6 AND n - (n - 1) // 6 * 6 < 5),
 m AS (SELECT u, win, '## ' || printf('%02d:%02d:00', win // 3, win % 3 * 20) || chr(10) || chr(10) || string_agg(w, ' ' ORDER BY k) t FROM b GROUP BY u, win)
 SELECT 'talks/' || u || '.mp3' AS source, md5('# Transcript: ' || u || '.mp3' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY win) || chr(10)) digest FROM m GROUP BY u""")  # fmt: skip
def overlapping_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve words of which six were heard before, as one text (S12-S14, S22); fewer than five at the end are no repetition."""
    from pyspark.sql import Window

    e = T.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("u"), "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("k"))
    own = F.floor(F.col("k") / 6)
    w = e.select("u", "k", F.concat(F.lit("w"), "event_id").alias("w"), F.explode(F.array_distinct(F.array(own, F.greatest(own - 1, F.lit(0))))).alias("win"))
    lists = w.groupBy("u", "win").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("l"))
    rows = lists.select(F.concat(F.lit("talks/"), "u", F.lit(".mp3")).alias("source"), (F.col("win") * 1_200_000).alias("start_ms"), F.array_join(F.transform("l", lambda x: x["w"]), " ").alias("text"))
    return documents.transcripts(rows).select("source", F.md5(F.col("markdown").cast("binary")).alias("digest"))


class _Listener:
    """A transcriber that says which window it heard and how much it was told."""

    def transcribe(self, source: str, start_ms: int, end_ms: int, prompt: str | None) -> str:
        return f"{start_ms}-{end_ms}|{len(prompt or '')}"


@query("""WITH RECURSIVE d AS (SELECT n_name s, (n_nationkey + 1) * 301000 ms FROM nation), h AS (SELECT 'Names that may be heard, to be written just so where they are: ' || string_agg(r_name, '; ' ORDER BY r_regionkey) || '.' names FROM region),
 w AS (SELECT s, ms, 0 a, least(1205000, ms) b, '0-' || least(1205000, ms) || '|' || length(names) t FROM d CROSS JOIN h UNION ALL
 SELECT s, ms, a + 1200000, least(a + 2405000, ms), (a + 1200000) || '-' || least(a + 2405000, ms) || '|' || length(names || chr(10) || 'Said just before: ' || t) FROM w CROSS JOIN h WHERE a + 1205000 < ms)
 SELECT s AS source, a::BIGINT start_ms, b::BIGINT end_ms, t AS text FROM w""")  # fmt: skip
def transcribed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files heard window by window, each told the names and what was said before."""
    terms = [r.r_name for r in T.table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]  # five names

    def run(batches):
        for batch in batches:
            rows = [(s, *w) for s, ms in zip(batch["source"], batch["ms"], strict=True) for w in documents.checked_windows(ms, documents.transcribe(s, ms, _Listener(), terms))]
            yield pd.DataFrame(rows, columns=["source", "start_ms", "end_ms", "text"])

    d = T.table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), ((F.col("n_nationkey") + 1) * 301000).cast("long").alias("ms"))
    return d.mapInPandas(run, "source string, start_ms long, end_ms long, text string")


# --- files and stores ----------------------------------------------------------------------------------------------------------


@query("SELECT 'documents/' || r_name || '/' || n_name || '.md' AS source, '# ' || n_name || chr(10) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey")
def loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files of folders below one, read by Spark."""
    folder = _folder(spark)
    names = T.table(spark, sf_dir, "nation").join(T.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    for r in names.collect():  # twenty-five files
        store.write_text(spark, f"{folder}/documents/{r.r_name}/{r.n_name}.md", f"# {r.n_name}\n")
    return _kept(spark, documents.load_documents(spark, f"{folder}/documents"), folder)


@query("SELECT doc_id, source, n_chars + 1 AS n, true known FROM documents WHERE source = 'src1'")
def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source of a table after two commits, and whether tables exist."""
    folder, d = _folder(spark), T.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("n"))
    s = store.SnapshotStore(spark, folder)
    s.commit({"chunks": d, "graph_nodes": d.limit(0)})
    s.commit({"chunks": d.withColumn("n", F.col("n") + 1)})
    known = s.exists("chunks") and not s.exists("graph_nodes") and not s.exists("kb_nodes") and s.version() == 2
    return _kept(spark, s.load("chunks", source="src1", order=["doc_id"]).withColumn("known", F.lit(known)), folder)


@query("""SELECT 'cached' kind, r_name AS source, n_name chunk_id, length(n_name)::BIGINT n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 UNION ALL SELECT 'cached', 'ASIA', 'again', 1 UNION ALL
 SELECT 'dropped', r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'dropped', r_name, n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey""")  # fmt: skip
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached extractions of which one source is written again, and dropped edges appended twice, as JSON."""
    folder, n = _folder(spark), T.table(spark, sf_dir, "nation").join(T.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("r_name").alias("source"), F.col("n_name").alias("chunk_id"), F.length("n_name").cast("long").alias("n"))
    store.write_extractions(rows, f"{folder}/cache")
    store.write_extractions(spark.createDataFrame([("ASIA", "again", 1)], rows.schema), f"{folder}/cache")
    for _ in range(2):
        store.append_json_lines(rows.drop("n"), f"{folder}/dropped")
    cached = store.extraction_rows(spark, f"{folder}/cache", "source string, chunk_id string, n long").select(F.lit("cached").alias("kind"), "source", "chunk_id", "n")
    dropped = spark.read.schema("source string, chunk_id string, created_at string").json(f"{folder}/dropped").where("created_at IS NOT NULL")
    return _kept(spark, cached.unionByName(dropped.select(F.lit("dropped").alias("kind"), "source", "chunk_id", F.lit(1).cast("long").alias("n"))), folder)


@query(f"""WITH {SUGGEST}, p AS (SELECT t FROM a WHERE node_count >= 5 AND source_count >= 2 AND t <> 'view') SELECT t AS type, 2 AS version, (SELECT 2 * count(*) FROM p)::INT audited FROM p UNION ALL SELECT 'view', 2, (SELECT 2 * count(*) FROM p)::INT""")
def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry after promotions, saved and loaded, and an audit that was appended to twice."""
    folder = _folder(spark)
    held, audit = registry.RegistryFile(spark, f"{folder}/types.json"), registry.AuditFile(spark, f"{folder}/promotions.json")
    first = taxonomy.Registry(types={"view": ""})
    new = taxonomy.promotable(taxonomy.aggregate_suggestions(T.suggestions(spark, sf_dir)), first).select("normalized", "reason").orderBy("normalized").collect()  # a handful of types
    held.save(first.promoted([r.normalized for r in new]))
    for _ in range(2):
        audit.append([r.asDict() for r in new])
    loaded = held.load_or_default()
    rows = [(t, loaded.version, len(audit.load())) for t in loaded.types]
    remove(spark, folder)
    return spark.createDataFrame(rows, "type string, version int, audited int")


@query("SELECT lower(r_name) AS scope, 'documents/' || r_name AS prefix FROM region")
def scope_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of folders, read from a catalogue."""
    names = [r.r_name for r in T.table(spark, sf_dir, "region").collect()]  # five names
    return scopes.scope_frame(spark, scopes.parse_scopes(json.dumps({f" {n} ": f"documents\\{n}/" for n in names})))


# --- conversion ------------------------------------------------------------------------------------------------------------------


class _Upper:
    """A page converter that fails on every batch of several pages which holds a page that is divisible by 7."""

    def convert(self, source: str, pages: list[tuple[int, str]], context: str) -> list[tuple[int, str, bool]]:
        if len(pages) > 1 and any(n % 7 == 0 for n, _ in pages):
            raise ValueError("too much at once")
        return [(n, f"\r\n{t[:300]} ({n})\r", not t.strip()) for n, t in pages]


@query(r"""WITH p AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM documents)
 SELECT source, md5(string_agg(CASE WHEN regexp_matches(text, '\S') THEN '<!-- sparkloom:page=' || n || ' -->' || chr(10) || chr(10) || regexp_replace(left(text, 300) || ' (' || n || ')', '^\s+', '') ELSE '<!-- sparkloom:page=' || n || ' -->' END, chr(10) || chr(10) ORDER BY n) || chr(10)) digest FROM p GROUP BY source""")  # fmt: skip
def converted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through a converter in batches, those that fail page by page, checked and put together."""
    from pyspark.sql import Window

    d = T.table(spark, sf_dir, "documents").select("source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("page"), "text")
    return documents.convert_documents(d, _Upper()).select("source", F.md5(F.col("markdown").cast("binary")).alias("digest"))


def _pdf(source: str, content: bytes) -> bytes:
    """As many empty pages as the content has bytes beyond a multiple of three, and one."""
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj << /Type /Page /Parent 1 0 R >> endobj\n" % (k + 2) for k in range(len(content) % 3 + 1)) + b"1 0 obj << /Type /Pages >> endobj\n%%EOF\n"


@query("""SELECT p_name || '-' || p_partkey || '.pptx' AS source, sha256(p_name || p_partkey) hash, length(p_name || p_partkey)::INT % 3 + 1 pages, CASE WHEN length(p_name || p_partkey) % 3 = 0 THEN 'slide 1' ELSE 'slides 1-' || length(p_name || p_partkey) % 3 + 1 END AS label,
 'pages-00001-0000' || length(p_name || p_partkey) % 3 + 1 || '.json' batch FROM part""".replace("'slides 1-' || length(p_name || p_partkey) % 3 + 1", "'slides 1-' || (length(p_name || p_partkey) % 3 + 1)").replace("'pages-00001-0000' || length(p_name || p_partkey) % 3 + 1 ||", "'pages-00001-0000' || (length(p_name || p_partkey) % 3 + 1) ||"))  # fmt: skip
def slide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentations made PDF files, checked, with what their batches are called."""
    content = F.concat("p_name", F.col("p_partkey").cast("string"))
    files = T.table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("-"), "p_partkey", F.lit(".pptx")).alias("source"), content.cast("binary").alias("content"))
    out = documents.slide_documents(files, _pdf)
    return out.select("source", "hash", "pages", documents.page_label(F.col("source"), F.lit(1), F.col("pages")).alias("label"), documents.batch_file(F.lit(1), F.col("pages")).alias("batch"))


@query("SELECT n_name AS source, n_nationkey::BIGINT hash FROM nation")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests saved and loaded, and none where none was saved."""
    folder, rows = _folder(spark), []
    for r in T.table(spark, sf_dir, "nation").collect():  # twenty-five
        documents.save_manifest(spark, f"{folder}/{r.n_nationkey}.json", {"source": r.n_name, "hash": r.n_nationkey})
        documents.save_manifest(spark, f"{folder}/{r.n_nationkey}.json", documents.load_manifest(spark, f"{folder}/{r.n_nationkey}.json"))
        got = documents.load_manifest(spark, f"{folder}/{r.n_nationkey}.json")
        rows.append((got["source"], got["hash"]))
    rows += [(m["source"], m["hash"]) for m in [documents.load_manifest(spark, f"{folder}/none.json")] if m]
    remove(spark, folder)
    return spark.createDataFrame(rows, "source string, hash long")


# --- texts ---------------------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, '{"a": [' || event_id || ', "é"], "b": {"k": ' || json_extract(props, '$.k') || '}}' canonical, printf('%.3f', event_id * 7 / 1000.0) AS seconds FROM events""".replace('"é"', '"\\u00e9"'))
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in one form, and seconds with three digits."""
    raw = F.concat(F.lit('{"b":'), "props", F.lit(',"a":['), "event_id", F.lit(',"é"]}'))
    return T.table(spark, sf_dir, "events").select("event_id", text.canonical_json_text(raw).alias("canonical"), text.seconds_label(F.col("event_id") * 7).alias("seconds"))


@query("""SELECT conv_id, turn, length(text) // 4 + 3 tokens FROM conversations""")
def approximate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What messages are counted as before any tokenizer sees them."""
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", agent.approximate_tokens(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, md5('Name the things that this text is about and how they relate, few rather than many. Types: tool, person. Nothing of the document''s own structure counts.' || chr(10) || chr(10) || 'It stands under (not to be used itself): ' || CASE WHEN doc_id % 2 = 0 THEN lang || ' > ' || source ELSE '(none)' END || chr(10) || chr(10) || text) prompt FROM documents""")
def extraction_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about each chunk."""
    path = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    return T.table(spark, sf_dir, "documents").select("doc_id", F.md5(graph_build.extraction_prompt(F.col("text"), path, ["tool", "person"]).cast("binary")).alias("prompt"))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def scoped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors of the chunks of a scope."""
    c = T.chunks(spark, sf_dir).where(retrieval.in_scope(F.col("source"), "documents/src1"))
    v = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.scoped_vectors(v, c).select(F.col("id").cast("long").alias("vec_id"))


# --- resolution and maintenance --------------------------------------------------------------------------------------------------------

_NO_STRINGS = "CAST(array() AS array<string>)"


def _plain_resolver() -> resolution.Resolver:
    """Everything looks alike, and the judge never merges: only names do."""
    return resolution.Resolver(embed=lambda texts: [[1.0, 0.0]] * len(texts), judge=lambda node, candidates: resolution.Decision("new"))


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    i = F.concat(F.lit("p"), "p_partkey")
    return p.select(i.alias("canonical_id"), F.col("p_partkey").cast("long").alias("ord"), F.col("p_brand").alias("source"), F.lit("h").alias("content_hash"), i.alias("node_id"), F.col("p_name").alias("label"), F.col("p_type").alias("type"), F.lit(None).cast("string").alias("suggested_type"), F.expr(_NO_STRINGS).alias("aliases"), F.lit("{}").alias("properties"), F.array(F.lit("c")).alias("chunk_ids"), F.expr(_NO_STRINGS).alias("resolution_aliases"))


def _with_nothing(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return resolution.with_signals(rows, spark.createDataFrame([], "id string, relations array<string>"), spark.createDataFrame([], "id string, vector array<float>"))


@query(f"""SELECT 'p' || p_partkey node_id, 'p' || min(p_partkey) OVER (PARTITION BY p_brand, {sql_name('p_name')}, {sql_type('p_type')}) entity_id FROM part""")
def resolved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each document that are one, by the fold."""
    return resolution.resolve_documents(_with_nothing(spark, _part_nodes(spark, sf_dir)), _plain_resolver).select("node_id", "entity_id")


@query(f"""WITH p AS (SELECT p_partkey o, p_brand b, {sql_name('p_name')} nm, {sql_type('p_type')} t, p_partkey % 4 = 0 old FROM part), k AS (SELECT nm, t, min(o) m FROM p WHERE old GROUP BY nm, t),
 n AS (SELECT *, min(o) OVER (PARTITION BY nm, b) bo FROM p WHERE NOT old), f AS (SELECT nm, t, arg_min(b, bo) b FROM n GROUP BY nm, t), fm AS (SELECT n.nm, n.t, min(o) m FROM n JOIN f ON f.nm = n.nm AND f.t = n.t AND f.b = n.b GROUP BY n.nm, n.t)
 SELECT 'p' || n.o node_id, 'p' || coalesce(k.m, CASE WHEN n.b = f.b THEN n.o ELSE fm.m END) entity_id FROM n JOIN f ON f.nm = n.nm AND f.t = n.t JOIN fm ON fm.nm = n.nm AND fm.t = n.t LEFT JOIN k ON k.nm = n.nm AND k.t = n.t""")  # fmt: skip
def resolved_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents' nodes among known entities, each document seeing what was known when it began."""
    rows = _part_nodes(spark, sf_dir)
    old = F.col("ord") % 4 == 0
    return resolution.resolve_into(*[_with_nothing(spark, rows.where(c)) for c in (old, ~old)], _plain_resolver).select("node_id", "entity_id")


class _Flaky(clients.WordExtraction):
    """Answers badly the first time that it sees a text."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def extract(self, text: str, heading_path: list[str]) -> tuple[list[dict], list[dict]]:
        if text not in self.seen:
            self.seen.add(text)
            raise ValueError("no structure")
        return super().extract(text, heading_path)


@query(f"WITH ct AS (SELECT 'b' || item_id id, text FROM benchmark), {CAPITALS} SELECT 'b' || item_id chunk_id, count(w)::BIGINT n FROM benchmark LEFT JOIN cn ON cn.id = 'b' || item_id GROUP BY item_id")
def retried_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions of a model whose first answers are bad."""
    c = T.table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("key"), F.concat(F.lit("b"), "item_id").alias("id"), "text", F.expr(_NO_STRINGS).alias("heading_path"))
    return clients.extract_chunks(c, _Flaky(), graph_build.EXTRACTION_SCHEMA).select("chunk_id", F.size("nodes").cast("long").alias("n"))


SYNCED = "'b' || item_id || '-' || left(sha256('documents/b' || item_id || '.md'), 8) || '-chunk-0000'"


@query(f"""WITH b AS (SELECT item_id, {SYNCED} id, text || CASE WHEN item_id % 2 = 0 THEN ' Zulu' ELSE '' END AS text FROM benchmark WHERE item_id % 3 > 0), ct AS (SELECT id, text FROM b), {CAPITALS}
 SELECT id || '::node-' || lpad(k::VARCHAR, 4, '0') id, w AS label, id chunk_ids FROM cn""")  # fmt: skip
def synchronized_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge base after documents were added, then changed and deleted."""
    folder, b = _folder(spark), T.table(spark, sf_dir, "benchmark")
    path = F.concat(F.lit("documents/b"), "item_id", F.lit(".md")).alias("source")
    corpus = Corpus(store.SnapshotStore(spark, folder), clients.WordExtraction())
    corpus.synchronize(b.select(path, F.col("text").alias("markdown")))
    corpus.synchronize(b.where("item_id % 3 > 0").select(path, F.concat("text", F.when(F.col("item_id") % 2 == 0, " Zulu").otherwise("")).alias("markdown")))
    out = corpus.store.load("kb_nodes").select("id", "label", F.array_join("chunk_ids", "|").alias("chunk_ids"))
    return _kept(spark, out, folder)


# --- the agent ----------------------------------------------------------------------------------------------------------------------------


class _Scripted:
    """Takes a question apart into its words, searches each once, looks around the first hit, and cites all that it has."""

    def __init__(self) -> None:
        self.names: list[str] = []

    def decompose(self, prompt: str) -> agent.Plan:
        self.words = prompt.rsplit("\n", 1)[1].split("; ")
        self.steps = [agent.Step("search", {"query": w}) for w in self.words]
        return agent.Plan(self.words)

    def research(self, prompt: str, correction: bool) -> agent.Step:
        return self.steps.pop(0)

    def evaluate(self, prompt: str) -> agent.Verdict:
        return agent.Verdict("sufficient")

    def answer(self, prompt: str) -> agent.Draft:
        return agent.Draft("Found.", [f"S{k}" for k in range(1, len(self.words) + 1)])

    def summarize(self, prompt: str) -> str:
        return ""


@query("""SELECT r_name AS thread, 'complete' status, count(*)::INT searches, string_agg(n_nationkey, ',' ORDER BY n_name) AS pages FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def agent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each region, answered from its nations."""
    rows = T.table(spark, sf_dir, "nation").join(T.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey").orderBy("r_name", "n_name").collect()  # twenty-five
    pages, parts = {r.n_name: r.n_nationkey for r in rows}, {}
    for r in rows:
        parts.setdefault(r.r_name, []).append(r.n_name)
    find = lambda q, scope: [agent.Hit("nations.md", q, q, pages[q], pages[q])]
    out = []
    for name, nations in parts.items():
        bot = agent.Agent(_Scripted(), find, lambda source, chunk: (None, agent.Hit(source, chunk, chunk), None))
        got = bot.ask("; ".join(nations), name)
        out.append((name, got.status, got.searches, ",".join(str(p[1]) for p in got.references)))
        bot.reset(name)
    return spark.createDataFrame(out, "thread string, status string, searches int, pages string")


@query("""SELECT n_name AS name, 'Previous chunk: [None]' || chr(10) || chr(10) || 'Current chunk [' || n_name || ' | nations.md' || CASE WHEN n_nationkey > 0 THEN ' | pages ' || n_nationkey || '-' || (n_nationkey + 1) ELSE '' END || ']' || chr(10) || n_name || chr(10) || chr(10) || 'Next chunk: [None]' AS text FROM nation""")
def neighborhood_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk and its missing neighbours as text."""
    rows = T.table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()  # twenty-five
    hit = lambda r: agent.Hit("nations.md", r.n_name, r.n_name, r.n_nationkey or None, r.n_nationkey + 1 if r.n_nationkey else None)
    return spark.createDataFrame([(r.n_name, agent.neighborhood_text(None, hit(r), None)) for r in rows], "name string, text string")
