"""Column functions: paths, globs, package ids, scores."""
