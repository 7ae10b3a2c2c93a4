"""Snapshot tables with all-or-nothing commits.

A commit writes every changed table into a folder of a new version, with Parquet's own committer, then publishes by one rename of
a draft to a pointer file of that version. Readers take the pointer with the highest number; there is always one, and an unfinished
commit leaves folders that no pointer names. A version that another writer has published meanwhile is not overwritten: the commit
raises. Paths go through Hadoop's file system interface, so any shared store that Spark can write to will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a corpus and how their rows are keyed.
TABLES = {
    "chunks": ["id"], "chunk_embeddings": ["id"], "graph_metadata": ["source"], "graph_nodes": ["source", "id"], "graph_edges": ["source", "id"],
    "graph_embeddings": ["source", "id"], "kb_nodes": ["id"], "kb_edges": ["id"], "kb_node_provenance": ["canonical_id", "ord"],
    "kb_edge_provenance": ["canonical_id", "ord"], "kb_embeddings": ["id"], "taxonomy_suggestions": ["source", "ord"], "extractions": ["key"],
    "dropped_edges": ["source", "chunk_id", "edge_id"], "document_counters": ["source"],
}


class SnapshotStore:
    """Versioned tables under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        fs, place = self._fs(), self._path("")
        names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n[8:]) for n in names if n.startswith("CURRENT.") and n[8:].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        """Table name to folder, of a version, the last one published by default; empty before the first commit."""
        if version is None:
            known = self._pointers()
            if not known:
                return {}
            version = known[-1]
        return json.loads(read_text(self.spark, f"{self.root}/CURRENT.{version:010d}"))["tables"]

    def version(self) -> int:
        """The last published version, 0 before the first."""
        return max(self._pointers(), default=0)

    def exists(self, name: str) -> bool:
        """Whether a table was ever published and holds a row."""
        folder = self._manifest().get(name)
        return folder is not None and not self.spark.read.parquet(f"{self.root}/{folder}").isEmpty()

    def load(self, name: str, *, source: str | None = None, order: Iterable[str] = ()) -> DataFrame:
        """A table, one source of it, in an order if one is asked for (S18, S30, S31). An unknown table raises."""
        folder = self._manifest().get(name)
        if folder is None:
            raise FileNotFoundError(f"no table {name!r} has been published under {self.root}")
        table = self.spark.read.parquet(f"{self.root}/{folder}")
        table = table if source is None else table.where(F.col("source") == source)
        return table.orderBy(*order) if order else table

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Publishes new snapshots of the given tables at once; the others stay as they are."""
        before = self.version()
        version, known = before + 1, self._manifest(before) if before else {}
        folder = f"v{version}/{uuid.uuid4().hex[:8]}"
        for name, table in tables.items():
            table.write.parquet(f"{self.root}/{folder}/{name}")
        known |= {name: f"{folder}/{name}" for name in tables}
        self._publish(version, json.dumps({"version": version, "tables": known}, sort_keys=True))
        return version

    def _publish(self, version: int, text: str) -> None:
        """Writes a draft and renames it to the version's pointer."""
        place = self._path(f"CURRENT.{version:010d}")
        if self._fs().exists(place):
            raise FileExistsError(f"version {version} has been published by another writer")
        write_text(self.spark, f"{self.root}/CURRENT.{version:010d}", text)

    def vacuum(self) -> int:
        """Deletes all versions but the last and what it names; returns how many folders went."""
        for old in self._pointers()[:-1]:
            self._fs().delete(self._path(f"CURRENT.{old:010d}"), False)
        fs, live, gone = self._fs(), {f.rsplit("/", 1)[0] for f in self._manifest().values()}, 0
        for version in fs.listStatus(self._path("")):
            if version.isDirectory():
                for part in fs.listStatus(version.getPath()):
                    name = f"{version.getPath().getName()}/{part.getPath().getName()}"
                    if name not in live:
                        fs.delete(part.getPath(), True)
                        gone += 1
        return gone


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def text_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the shared store, whole or not at all: written beside its place and renamed there."""
    place, draft = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.draft"))
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    kinds = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = overwrite
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, kinds)


def append_json_lines(rows: DataFrame, path: str) -> None:
    """Appends rows with the time as JSON lines, such as dropped edges."""
    rows.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).write.mode("append").json(path)


def extraction_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cached extractions as JSON under a fixed schema; a malformed row raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_extractions(rows: DataFrame, path: str) -> None:
    """Extraction cache, one folder per source, sorted by chunk; written sources are replaced."""
    rows.repartition("source").sortWithinPartitions("source", "chunk_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").json(path)
