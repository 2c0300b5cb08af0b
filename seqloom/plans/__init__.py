"""Whole queries and pipelines, composed of the operators."""
