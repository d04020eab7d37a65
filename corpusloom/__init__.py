"""corpusloom: Spark-first processing and querying of a versioned document corpus."""
