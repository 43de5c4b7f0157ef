"""Training-data operators: near-duplicates, quality, toxicity, sharding, packing, mixing, URL and chat tools.

Nothing else in the library imports this subpackage. Each operator is a module of its own with a general
interface; ``queries`` holds the thin registered queries and their SQL.
"""
