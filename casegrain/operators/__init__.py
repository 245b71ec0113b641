"""Operators over the normalised evidence tables."""
