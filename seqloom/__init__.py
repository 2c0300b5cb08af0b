"""Sequence analytics on Spark: feature mining, sequence labelling and their reports."""
