"""Column functions and Arrow parsers for program text."""
