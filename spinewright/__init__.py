"""Catalogue and deduplicate book libraries, and prepare text corpora, on Spark."""
