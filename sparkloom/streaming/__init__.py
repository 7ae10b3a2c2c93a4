"""Streaming wrappers; an extension, as maintenance itself works on batches."""
