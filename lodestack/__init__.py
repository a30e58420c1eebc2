"""A document-corpus engine on Spark: inventory, extraction, token budgets, corpora and reports."""

__version__ = "0.1.0"
