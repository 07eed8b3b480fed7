"""Repository analytics and corpus preparation on Spark."""
