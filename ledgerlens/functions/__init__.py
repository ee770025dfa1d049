"""Column expressions: exact decimals, text normalisation, evidence predicates, cell coordinates."""
