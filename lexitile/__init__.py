"""Segmentation and translation-memory engine for markup corpora on Spark DataFrames."""
