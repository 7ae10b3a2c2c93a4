"""Whole plans: building and searching a knowledge base, the research agent, and the registered queries."""
