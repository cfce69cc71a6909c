"""Column-level building blocks: rule catalogue, text, path and byte expressions."""
