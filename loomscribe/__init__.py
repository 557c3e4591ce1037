"""Repository knowledge analytics as Spark DataFrame transformations."""
