"""Training-data operators: mixing, search, tokens, scores, filters and duplicates.

Nothing outside this package imports it; ``queries`` holds the registered
queries and their SQL.
"""
