"""Column functions built on Spark SQL expressions."""
