"""Knowledge-base building and retrieval as plain Spark DataFrame jobs."""
