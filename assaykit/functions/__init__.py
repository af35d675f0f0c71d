"""Column functions: text, formulas, stoichiometry and material strings."""
