"""Corpus operators for building language-model training data.

Nothing else in the package imports this subpackage; it may be removed without
affecting the retrieval engine.
"""
