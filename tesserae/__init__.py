"""Multi-way contact analytics as lazy PySpark DataFrame operators."""
