"""Graphs as HTML pages. Titles are made by Spark; a page is written row by row, so the driver holds one partition at a time."""

from __future__ import annotations

import json
import shutil
import tempfile
from html import escape
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import escape_html


def title(fields: list[tuple[str, Column]]) -> Column:
    """Escaped ``name: value`` lines of a hover text."""
    return F.concat_ws("<br>", *[F.concat(F.lit(f"<b>{name}</b>: "), escape_html(value)) for name, value in fields])


def node_titles(nodes: DataFrame) -> DataFrame:
    """``id, label, title``."""
    quoted = F.concat(F.lit("["), F.array_join(F.transform("chunk_ids", lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ", "), F.lit("]"))
    return nodes.select("id", "label", title([("id", F.col("id")), ("type", F.col("type")), ("suggested_type", F.coalesce("suggested_type", F.lit("null"))), ("chunk_ids", quoted), ("properties", F.coalesce("properties", F.lit("{}")))]).alias("title"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str | Path) -> Path:
    """One page with all nodes, those with the most edges first, and all edges between them."""
    degree = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    drawn = node_titles(nodes.join(degree, "id", "left").orderBy(F.desc_nulls_last("d"), "id"))
    ids = nodes.select("id")
    lines = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    lines = lines.select("id", "from_id", "to_id", "label").orderBy("id", "from_id", "to_id", "label")
    place = Path(path)
    place.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryFile("w+", encoding="utf-8") as data, place.open("w", encoding="utf-8") as page:
        page.write('<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph</title></head><body><ul>')
        for k, n in enumerate(drawn.toLocalIterator()):
            page.write(f'<li title="{n["title"].replace(chr(34), "&quot;")}">{escape(n["label"] or "")}</li>')
            data.write(", " * (k > 0) + json.dumps(n.asDict()).replace("</", "<\\/"))
        page.write('</ul><script type="application/json" id="graph">{"nodes": [')
        data.seek(0)
        shutil.copyfileobj(data, page)
        page.write('], "edges": [')
        for k, e in enumerate(lines.toLocalIterator()):
            page.write(", " * (k > 0) + json.dumps(e.asDict()).replace("</", "<\\/"))
        page.write("]}</script></body></html>")
    return place


def export_pages(graphs: dict[str, tuple[DataFrame, DataFrame]], combined: tuple[DataFrame, DataFrame], folder: str | Path) -> list[Path]:
    """A page for each document's graph (by source key) and one for all; pages of other documents are removed."""
    place = Path(folder) / "documents"
    pages = [write_graph(n, e, place / f"{key}.html") for key, (n, e) in graphs.items()]
    for old in place.glob("*.html") if place.exists() else ():
        if old not in pages:
            old.unlink()
    return [*pages, write_graph(*combined, Path(folder) / "knowledge_graph.html")]
