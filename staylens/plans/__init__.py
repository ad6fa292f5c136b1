"""Compositions of operators: cleaning run, normalisation, view, dashboard."""
