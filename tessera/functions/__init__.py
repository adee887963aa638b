"""Column functions: fingerprints, predicates and classifications."""
