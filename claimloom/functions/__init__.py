"""Code lists and column expressions."""
