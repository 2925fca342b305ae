"""Operators for large training-data collections. Nothing outside this subpackage imports it."""
