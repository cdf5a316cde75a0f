"""Composed plans: the derived corpus and end-to-end pipelines."""
