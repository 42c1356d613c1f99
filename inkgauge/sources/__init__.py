"""Readers, writers and the explicit schemas they use."""
