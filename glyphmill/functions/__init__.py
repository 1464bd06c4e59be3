"""Column expressions: text, chunking, selection, formatting."""
