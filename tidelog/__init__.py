"""tidelog: recursive and relational analytics on PySpark."""
