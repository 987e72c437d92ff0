"""Operators on the texts of a corpus. Nothing outside this package imports it."""
