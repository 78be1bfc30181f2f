"""Market feature engine on PySpark."""
