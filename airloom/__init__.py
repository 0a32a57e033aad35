"""airloom: environmental time-series analytics as Spark DataFrame jobs."""
