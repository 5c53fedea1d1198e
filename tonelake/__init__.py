"""Product and music analytics as Spark DataFrame operators."""
