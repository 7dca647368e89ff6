"""terraloom: spatial retrieval, fusion and field analytics on PySpark."""
