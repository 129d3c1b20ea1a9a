"""Whole reports composed from the operators, and the table bindings."""
