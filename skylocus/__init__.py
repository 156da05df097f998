"""A Spark-native engine that locates aerial video frames on a map."""
