"""Training-data operators: quality, deduplication, privacy, mixing and packing of documents.

Nothing outside this subpackage imports it; :mod:`stratum.llm.queries` lists its queries.
"""
