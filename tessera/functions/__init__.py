"""Column builders: text, hashes, labels, similarity."""
