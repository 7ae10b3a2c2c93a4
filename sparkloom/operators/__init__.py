"""Relational operators of the engine: scoring, chunking, graph building, provenance, resolution, taxonomy, retrieval, sync."""
