"""Training-data operators: URL filters, quality rules, language ID, LM scoring, PII,
token files, packing, HTML extraction, set-similarity join and decontamination.

Nothing else in the library imports this subpackage.
"""
