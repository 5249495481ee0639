"""Transcript-to-knowledge engine on PySpark DataFrames."""
