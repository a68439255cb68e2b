"""Operations of a large-scale training-data pipeline.

Twelve operators over a ``documents`` table, each in a module of its own, and
``registry`` with the thin queries that bind them to their contracts.
Nothing outside this subpackage imports it.
"""
