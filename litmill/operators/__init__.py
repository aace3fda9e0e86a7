"""Relational operators of the corpus pipeline, written as DataFrame transformations."""
