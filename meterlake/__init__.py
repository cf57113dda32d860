"""Usage and cost analytics as composable Spark DataFrame operations."""
