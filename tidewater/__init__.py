"""Event and array analytics as composable PySpark DataFrame operators."""
