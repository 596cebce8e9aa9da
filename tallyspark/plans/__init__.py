"""Ledgers built from the test tables, the registered queries and their SQL."""
