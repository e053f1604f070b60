"""lateview: Spark-native late-interaction indexes and the decisions around them."""
