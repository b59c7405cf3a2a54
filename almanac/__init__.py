"""almanac: Spark-native analytics for periodic document collections."""
