"""corrobix: Spark-native analytics for facts corroborated across many sites."""
