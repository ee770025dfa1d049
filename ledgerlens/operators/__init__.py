"""Relational operators: controls over canonical rows, hierarchy, roll-ups, tables and formulas."""
