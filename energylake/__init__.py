"""energylake: distributed-energy telemetry analytics on Spark DataFrames."""
