"""lexloom: corpus-scale text analytics as Spark DataFrame jobs."""
