"""Operators for preparing training data: near duplicates, languages, licences, token files,
toxicity, mixing, sharding, quality rules and byte-pair encoding.

Nothing else in the library imports this subpackage.
"""
