"""Importers: files, markup and recognised words to tables."""
