"""Training-data operators: extraction, filtering, deduplication, mixing and tokenisation.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
