"""tidewell: a Spark-native analytics engine (DataFrame / SQL / Structured Streaming)."""
