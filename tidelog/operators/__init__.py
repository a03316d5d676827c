"""Relational operators as queries over the test tables, each with SQL for the same rows."""
