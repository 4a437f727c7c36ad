"""Column functions and header functions."""
