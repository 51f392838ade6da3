"""Training-data operators: dedup, language ID, filters, PII, packing, sharding, extraction.

Nothing outside this package imports it; its queries are in ``queries``.
"""
