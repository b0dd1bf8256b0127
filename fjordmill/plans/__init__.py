"""Queries over the test tables: operators bound to columns, each with the SQL that gives the same rows."""
