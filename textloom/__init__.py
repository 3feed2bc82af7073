"""Text analytics on Spark."""
