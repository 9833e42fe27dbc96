"""lodestrata: project memory, grounded retrieval and corpus queries on PySpark."""
