"""Operators for preparing large text corpora, one module each; ``queries`` registers them."""
