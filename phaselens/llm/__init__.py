"""Training-data operators: deduplication, filtering, search, tokenising and packing of text corpora.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries and their SQL.
"""
