"""Column functions: text, globs, identity, tokens."""
