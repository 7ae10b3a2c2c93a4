"""Keys and hashes of documents, chunks, nodes, edges and cached work."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import strip

#: Part of every content hash; another value makes all documents count as changed. A store that another tool wrote
#: is continued by giving that tool's tag.
INGESTION_TAG = "sparkloom-ingestion-v2"


def content_hash(content: Column, tag: str = INGESTION_TAG) -> Column:
    """SHA-256 of the tag, a zero byte and the content."""
    return F.sha2(F.concat(F.lit(tag), F.char(F.lit(0)), content), 256)


def source_key(source: Column) -> Column:
    """A slug of the file's stem, and eight digits of the path's hash."""
    path = strip(F.replace(source, F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.concat(F.when(slug == "", F.lit("source")).otherwise(slug), F.lit("-"), F.left(F.sha2(path, 256), F.lit(8)))


def chunk_id(key: Column, index: Column) -> Column:
    return F.format_string("%s-chunk-%04d", key, index.cast("long"))


def node_id(chunk: Column, number: Column) -> Column:
    return F.format_string("%s::node-%04d", chunk, number.cast("long"))


def edge_id(number: Column) -> Column:
    return F.format_string("edge-%04d", number.cast("long"))


def text_hash(text: Column) -> Column:
    """What an embedding of a text is filed under."""
    return F.sha2(text, 256)


def request_key(messages: list[dict], schema: dict, model: str | None) -> str:
    """The key of a cached model call: a hash of its messages, its response schema and the model."""
    body = {"messages": messages, "model": model, "response_schema": schema}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
