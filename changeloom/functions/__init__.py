"""Column functions with the text semantics that the rules rely on."""
