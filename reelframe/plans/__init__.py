"""Whole-query plans and the query catalogue."""
