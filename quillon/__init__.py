"""Vector search and corpus preparation as Spark plans."""
