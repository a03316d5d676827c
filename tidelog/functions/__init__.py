"""The reference's scalar functions, as one query for each family."""
