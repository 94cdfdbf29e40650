"""Signal and sequence analytics as PySpark DataFrame operators."""
