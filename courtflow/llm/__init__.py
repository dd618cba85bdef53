"""Operators for training-data pipelines over documents, pages and embeddings.

Nothing else in the library imports this subpackage; ``queries`` registers what it offers.
"""
