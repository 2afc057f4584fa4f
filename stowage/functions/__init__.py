"""Column functions: built-in expressions only, no UDFs."""
