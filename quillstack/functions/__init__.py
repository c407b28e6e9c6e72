"""Column functions: text, names, paths, levels and tags."""
