"""Machine learning over the tables, through Spark's own library."""
