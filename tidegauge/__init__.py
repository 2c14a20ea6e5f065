"""Data-science and model-operations work on tables and streams, written as Spark DataFrame jobs."""
