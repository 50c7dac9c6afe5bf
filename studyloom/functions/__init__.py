"""Column functions, rule tables and fixed values."""
