"""Network analytics as Spark jobs."""
