"""Document-workspace analytics as Spark jobs."""
