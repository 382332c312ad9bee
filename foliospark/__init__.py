"""foliospark: corpus building, profiling, retrieval and evaluation as Spark DataFrame jobs."""
