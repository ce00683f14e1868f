"""paperlake: research-paper libraries as Spark DataFrame jobs."""
