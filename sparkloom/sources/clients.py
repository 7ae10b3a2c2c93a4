"""Models and converters behind small interfaces, deterministic stand-ins for tests, and how Spark calls them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class EmbeddingClient(Protocol):
    """Vectors of texts; must be picklable, as executors call it."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ExtractionClient(Protocol):
    """Entities and relations of a chunk: (nodes, edges) as dictionaries."""

    model: str

    def extract(self, text: str, heading_path: list[str]) -> tuple[list[dict], list[dict]]: ...


class PageConverter(Protocol):
    """Markdown of a batch of pages."""

    def convert(self, source: str, pages: list[tuple[int, str]], context: str) -> list[tuple[int, str, bool]]: ...


class Transcriber(Protocol):
    """Text of an audio window."""

    def transcribe(self, source: str, start_ms: int, end_ms: int, prompt: str | None) -> str: ...


class HashEmbeddings:
    """A deterministic stand-in: a text's vector is drawn from its words' hashes."""

    def __init__(self, size: int = 16, model: str = "hash-16") -> None:
        self.size, self.model = size, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.size
            for word in text.lower().split():
                digest = hashlib.sha256(word.encode()).digest()
                vector[digest[0] % self.size] += 1.0 if digest[1] % 2 else -1.0
            out.append(vector)
        return out


class MarkerEmbeddings:
    """A stand-in that gives the vector of the first marker that stands in the text."""

    def __init__(self, vectors: dict[str, list[float]], default: list[float], model: str = "markers") -> None:
        self.vectors, self.default, self.model = vectors, default, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [next((v for marker, v in self.vectors.items() if marker in t), self.default) for t in texts]


class WordExtraction:
    """A stand-in: capitalised words are nodes, and neighbours in a text are linked."""

    model = "capitals"

    def extract(self, text: str, heading_path: list[str]) -> tuple[list[dict], list[dict]]:
        words = list(dict.fromkeys(w.strip(".,;:!?") for w in text.split() if w[:1].isupper() and len(w) > 2))[:8]
        nodes = [{"ref": f"n{i}", "label": w, "type": "concept", "suggested_type": None} for i, w in enumerate(words)]
        edges = [{"id": f"e{i}", "source_ref": f"n{i}", "target_ref": f"n{i + 1}", "label": "precedes"} for i in range(len(words) - 1)]
        return nodes, edges


def embed_texts(rows: DataFrame, client: EmbeddingClient, batch: int = 4) -> DataFrame:
    """``text_hash, vector, embedding_model`` of ``text_hash, text`` rows, ``batch`` texts a call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = [v for i in range(0, len(frame), batch) for v in client.embed(list(frame["text"].iloc[i : i + batch]))]
            yield pd.DataFrame({"text_hash": frame["text_hash"], "vector": vectors, "embedding_model": client.model})

    return rows.select("text_hash", "text").mapInPandas(run, "text_hash string, vector array<float>, embedding_model string")


def extract_chunks(chunks: DataFrame, client: ExtractionClient, schema: str) -> DataFrame:
    """``key, chunk_id, nodes, edges``: extractions of ``key, id, text, heading_path`` rows, tried once more on a bad answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                for attempt in (1, 2):
                    try:
                        nodes, edges = client.extract(r.text, list(r.heading_path))
                        if len({n["ref"] for n in nodes}) != len(nodes):
                            raise ValueError(f"repeated node references in {r.id}")
                        break
                    except ValueError:
                        if attempt == 2:
                            raise
                rows.append((r.key, r.id, nodes, edges))
            yield pd.DataFrame(rows, columns=["key", "chunk_id", "nodes", "edges"])

    return chunks.select("key", "id", "text", "heading_path").mapInPandas(run, f"key string, {schema}")
