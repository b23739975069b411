"""vecflow: text, vector and relational analytics as PySpark plans."""
