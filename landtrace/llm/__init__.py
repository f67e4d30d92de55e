"""Operators that prepare text corpora for training language models.

Each module is one operator over a documents table; ``queries`` registers them. Nothing
outside this subpackage imports it.
"""
