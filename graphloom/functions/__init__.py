"""Column functions: identifiers, paths, text and number shaping."""
