"""Operators over units, uses and edges."""
