"""A Spark-native engine for place-by-time panels, facility records, proximity, service cost and location models."""
