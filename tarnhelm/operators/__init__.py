"""Relational operators on text, findings, geometry and blocks."""
