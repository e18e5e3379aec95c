"""Spark jobs over crawled-web corpora: links, frontier, content, wiki metadata, tracking."""

__version__ = "0.1.0"
