"""citeloom: graph-augmented retrieval over text corpora, as Spark plans."""

__version__ = "0.1.0"
