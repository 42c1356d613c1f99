"""Relational operators: one DataFrame in, one DataFrame out."""
