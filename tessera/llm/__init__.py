"""Training-data operators: deduplication, filters, mixing, tokens and search.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their SQL; every other module is one operator.
"""
