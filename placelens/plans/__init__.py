"""Queries: operators composed over the given tables, and the SQL that checks them."""
