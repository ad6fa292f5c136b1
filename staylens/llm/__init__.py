"""Operators of a training-data pipeline (chat formatting, token counts,
packing, token files, similarity joins, PII, decontamination, near-duplicate
vectors, web archives, toxicity) and their registered queries. Nothing else
in the library imports this subpackage."""
