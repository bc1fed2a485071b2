"""tracelab: a Spark-native engine for dialogue-trace datasets."""
