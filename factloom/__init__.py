"""factloom: checked evidence analytics over documents and tables, as PySpark DataFrame operations."""
