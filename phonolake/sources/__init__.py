"""Readers and writers for the text and Parquet forms of a corpus."""
