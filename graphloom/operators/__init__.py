"""Relational operators on graphs, vectors and embeddings."""
