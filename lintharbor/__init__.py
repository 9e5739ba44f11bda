"""A Spark-native engine for static-analysis findings and fuzzing-campaign telemetry."""
