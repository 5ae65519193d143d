"""Operators for large-scale training-data pipelines.

Self-contained: nothing else in the library imports this subpackage, and it imports nothing
outside itself. ``textloom.llm.queries`` lists the registered queries.
"""
