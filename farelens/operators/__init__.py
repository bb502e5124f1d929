"""Reusable operators: enrichment, scalable n-tiles, min-max scores, extremes."""
