"""Operators for building training corpora: scoring, cleaning, deduplication, mixing and output.

Nothing outside this subpackage imports it. Each module holds one operator with its own general
interface; ``queries`` has the thin registered queries that derive their columns from them.
"""
