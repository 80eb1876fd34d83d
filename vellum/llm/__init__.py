"""Operators of a training-data pipeline: packing, deduplication, decontamination, sharding,
similarity joins, toxicity and quality models, chat formatting, quality rules, extraction.

Nothing else in the library imports this subpackage. Each module holds one operator and the
thin ``opN_<name>`` query over the given tables; ``queries`` collects them.
"""
