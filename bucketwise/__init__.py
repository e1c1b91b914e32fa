"""A Spark-native engine for log analytics and training-data preparation."""
