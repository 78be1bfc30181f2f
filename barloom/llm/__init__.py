"""Training-data operators: search, mixing, deduplication, filtering and formatting of text corpora.

Nothing else in the library imports this subpackage.
"""
