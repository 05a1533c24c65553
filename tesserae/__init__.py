"""Tesserae: full-text search and extraction over large corpora, on Spark DataFrames."""
