"""Training-data operators: tokenisation, deduplication, decontamination and language identification.

Nothing else in the package imports this subpackage.
"""
