"""Column expressions that Catalyst can optimise."""
