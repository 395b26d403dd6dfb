"""Corpus preparation for language-model training, as Spark jobs.

Nothing outside this subpackage imports it.  ``docloom.llm.catalog`` lists its
queries; each operator lives in a module of its own.
"""
