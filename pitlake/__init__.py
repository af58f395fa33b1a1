"""Point-in-time panel analytics on PySpark."""
