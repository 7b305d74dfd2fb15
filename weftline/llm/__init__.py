"""Training-data operators: sharding, privacy, quality, near-duplicates, language, packing, HTML, mixing, licences.

Nothing outside this subpackage imports it.
"""
