"""Training-data operators: scoring, deduplication, decontamination, extraction, mixing, token output.

Each module holds one operator with a general interface; ``queries`` registers
one query per operator over the whole tables. Nothing outside this package
imports it.
"""
