"""Company-registry and annual-account analytics as native Spark DataFrame jobs."""
