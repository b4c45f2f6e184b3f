"""Similarity search over labelled numeric profiles, expressed as Spark jobs."""

from profseek.config import Distance, SearchConfig

__all__ = ["Distance", "SearchConfig"]
