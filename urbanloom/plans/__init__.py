"""Queries: the operators bound to the tables of TESTDATA.md."""
