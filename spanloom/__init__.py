"""Timed text, spans, event records and entity matching on Spark DataFrames."""
