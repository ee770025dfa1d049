"""Incremental intake of package files."""
