"""Corpus-scale document editing and analysis as PySpark DataFrame jobs."""
