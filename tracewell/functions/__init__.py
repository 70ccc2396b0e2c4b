"""Column functions: identities, paths, text, JSON and verdicts."""
