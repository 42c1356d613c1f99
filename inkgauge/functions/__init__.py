"""Column-to-Column functions; no shuffle, no state."""
