"""Column functions: text, geometry and label rules."""
