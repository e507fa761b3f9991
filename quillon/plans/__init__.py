"""Index life cycle and the search builder."""
