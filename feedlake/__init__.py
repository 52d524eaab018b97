"""Feed and document analytics as Spark DataFrame jobs."""
