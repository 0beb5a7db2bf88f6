"""Spark-first gene prediction over DNA sequences: sources, labels, models, decoding, evaluation and export."""
