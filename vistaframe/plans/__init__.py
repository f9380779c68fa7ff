"""Queries of the visibility engine and the SQL that states the same results."""
