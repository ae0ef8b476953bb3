"""Training-data operators: tokens, packing, mixing, sharding, deduplication, search.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; :mod:`tessera.llm.queries` derives the registered queries.
"""
