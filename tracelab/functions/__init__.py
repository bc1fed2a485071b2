"""Column functions: text, hashes and numbers with fixed semantics."""
