"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries.py`` registers the
operators' queries with the repository's entry module.
"""
