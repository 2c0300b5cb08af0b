"""Readers and writers of the text formats, and the adapters from plain tables to sequences."""
