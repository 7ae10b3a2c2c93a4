"""The supplied tables seen as chunks, graphs, provenance, suggestions and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A stated set of queries.
QUERIES = [(1, "nation 7 and its region with the other"), (2, "que des la les para nation 12 of EUROPE"), (3, "MIDDLE EAST and nation 3 with nothing; land of nation 4"), (4, "und der die asia east"), (5, "")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_set(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth test item as a query against all documents."""
    return table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their source, in id order, with a page for every third."""
    d = table(spark, sf_dir, "documents")
    page = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 9 + 1).cast("int"))
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("documents/"), "source").alias("source"), F.col("doc_id").cast("int").alias("index"), "text", F.array("lang", "source").alias("heading_path"), page.alias("page_start"), page.alias("page_end"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as nodes; a nation's chunks are the documents of its number modulo 25."""
    n, r, s = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    owned = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 25).cast("int").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string")).alias("c"))
    none = F.array().cast("array<string>")
    region = r.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("label"), F.lit("organization").alias("type"), F.lit(None).cast("string").alias("suggested_type"), none.alias("aliases"), F.lit("{}").alias("properties"), none.alias("chunk_ids"))
    nation = n.join(owned, "n_nationkey", "left").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"), F.lit("concept").alias("type"), F.lit("country").alias("suggested_type"), F.array(F.concat(F.lit("land of "), F.lower("n_name"))).alias("aliases"), F.lit("{}").alias("properties"), F.coalesce("c", none).alias("chunk_ids"))
    supplier = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("label"), F.lit("organization").alias("type"), F.lit(None).cast("string").alias("suggested_type"), none.alias("aliases"), F.concat(F.lit('{"nation": '), F.col("s_nationkey"), F.lit("}")).alias("properties"), none.alias("chunk_ids"))
    return region.unionByName(nation).unionByName(supplier)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in regions, suppliers in nations."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    inside = n.select(F.concat(F.lit("en"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("from_id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("to_id"), F.lit("part of").alias("label"), F.lit("{}").alias("properties"), F.array(F.col("n_nationkey").cast("string")).alias("chunk_ids"))
    located = s.select(F.concat(F.lit("es"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("from_id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("to_id"), F.lit("located in").alias("label"), F.lit("{}").alias("properties"), F.array(F.col("s_suppkey").cast("string")).alias("chunk_ids"))
    return inside.unionByName(located)


def node_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as contributions to the entity of their name; brands are sources."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") < 25, "Unclassified").otherwise(F.col("p_type"))
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_name").alias("canonical_id"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("source"), F.lit("h").alias("content_hash"), F.concat(F.lit("p"), "p_partkey").alias("node_id"), label.alias("label"), kind.alias("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("suggested_type"), F.array("p_brand", F.lower("p_brand")).alias("aliases"), F.concat(F.lit('{"size": '), F.col("p_size"), F.lit("}")).alias("properties"), F.array(F.concat(F.lit("c"), F.col("p_partkey") % 10), F.concat(F.lit("d"), F.col("p_size") % 5)).alias("chunk_ids"), F.array().cast("array<string>").alias("resolution_aliases"))


def edge_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as contributions to supplies(supplier, part name); return flags are sources."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.concat_ws(">", F.col("l_suppkey").cast("string"), "p_name").alias("canonical_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.datediff("l_shipdate", F.lit("1970-01-01"))).alias("ord"), F.col("l_returnflag").alias("source"), F.lit("h").alias("content_hash"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("edge_id"), F.concat(F.lit("s"), "l_suppkey").alias("from_id"), F.col("p_name").alias("to_id"), F.col("l_linestatus").alias("label"), F.lit("{}").alias("properties"), F.array(F.concat(F.lit("m"), F.month("l_shipdate")), F.col("l_returnflag")).alias("chunk_ids"))


def extractions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and what a model might have extracted: an event is a node, neighbours in a user's history are linked; some
    labels name the document's structure, some edges lead nowhere."""
    e = table(spark, sf_dir, "events").withColumn("chunk_id", F.concat(F.lit("u"), F.col("user_id")))
    m = F.col("event_id") % 11
    label = F.when(m == 0, "Table").when(m == 1, "Chunk: Events!").when(m == 2, F.col("chunk_id")).otherwise(F.concat("event_type", F.lit(" "), F.col("event_id") % 5))
    node = F.struct(F.concat(F.lit("r"), "event_id").alias("ref"), label.alias("label"), F.when(m == 3, "File_Path").otherwise("concept").alias("type"), F.when(m == 4, F.col("event_type")).alias("suggested_type"))
    ahead = F.when(F.col("event_id") % 13 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("r"), F.col("event_id") + 1))
    edge = F.struct(F.concat(F.lit("e"), "event_id").alias("id"), F.concat(F.lit("r"), "event_id").alias("source_ref"), ahead.alias("target_ref"), F.lit("then").alias("label"))
    rows = e.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("event_id", node.alias("n"), edge.alias("e")))).alias("l"))
    got = rows.select("chunk_id", F.transform("l", lambda x: x["n"]).alias("nodes"), F.transform("l", lambda x: x["e"]).alias("edges"))
    made = rows.select(F.col("chunk_id").alias("id"), F.concat(F.lit("documents/"), "chunk_id").alias("source"), F.lit(0).alias("index"), F.array(F.lit("Log"), F.lit("Events")).alias("heading_path"))
    return made, got


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as suggestions: the kind is suggested for the user, the day is the source."""
    from sparkloom.functions.text import normal_type

    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("suggested_type"), normal_type(F.col("event_type")).alias("normalized"), F.concat(F.lit("u"), "user_id").alias("node_id"), F.col("event_type").alias("node_label"), F.lit("unclassified").alias("current_type"), F.date_format("ts", "yyyy-MM-dd").alias("source"), F.lit("c").alias("chunk_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("ord"))
