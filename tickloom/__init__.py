"""tickloom: tick factors and factor evaluation as plain Spark jobs."""
