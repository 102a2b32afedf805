"""corpusloom: corpus preparation and run analytics on Spark."""
