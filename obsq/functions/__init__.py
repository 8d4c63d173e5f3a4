"""Column-level building blocks: predicates, account scope, row validation."""
