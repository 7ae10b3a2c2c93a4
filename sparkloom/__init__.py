"""A PySpark engine that builds, maintains and searches a knowledge graph over a corpus of documents."""
