"""Zone-based surge pricing analytics, expressed as Spark DataFrame jobs."""
