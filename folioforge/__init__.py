"""Document knowledge-base jobs on Spark."""
