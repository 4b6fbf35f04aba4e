"""Operators for building training corpora: scoring, deduplication, packing, filtering.

Nothing else in the library imports this subpackage; its queries are in
``llm.queries`` and the staged pipeline is ``corpus_pipeline.py`` at the top of
the repository.
"""
