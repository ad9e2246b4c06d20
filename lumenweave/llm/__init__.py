"""Training-data operators: tokenising, deduplication, filtering, extraction, search and mixing.

Nothing outside this subpackage imports it.  ``queries`` holds the thin queries.
"""
