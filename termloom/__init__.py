"""termloom: text indexing and analytics on PySpark."""
