"""Operators for training-data pipelines over ``documents``, ``pages`` and ``benchmark``.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
