"""Communication analytics as Spark DataFrame operators."""
