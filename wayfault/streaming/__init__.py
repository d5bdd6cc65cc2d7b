"""Streaming forms of the interval operators (the analyses themselves are batch)."""
