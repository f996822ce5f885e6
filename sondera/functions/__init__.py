"""Column functions: vectors, paths, keyed order and small pieces of arithmetic."""
