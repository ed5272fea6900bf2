"""Operators for preparing text and embeddings as training data.  Nothing else in the library imports them."""
