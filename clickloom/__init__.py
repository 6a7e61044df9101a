"""Product and web analytics operators on the Spark DataFrame API."""
