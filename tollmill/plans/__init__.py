"""Toll views over the test tables, and the catalogue of runnable queries with their SQL twins."""
