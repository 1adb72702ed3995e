"""heddle: a Spark-native analytics engine for telemetry feeds and training-data corpora."""
