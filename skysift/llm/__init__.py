"""Training-data operators: scoring, tokens, deduplication, decontamination, archives, audits, url filters, alignment.

Nothing else in the library imports this subpackage; ``queries`` registers
its queries and SQL.
"""
