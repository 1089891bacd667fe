"""Operators for large training corpora: tokens, language, duplicates, leaks, secrets, vectors, packing, quality.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
