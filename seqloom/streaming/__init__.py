"""Tagging of streams."""
