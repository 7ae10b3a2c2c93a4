"""Column functions: text, identity, vectors, references."""
