"""Market-data analytics on Spark: bar lake, point-in-time joins, features, evaluation and back-tests."""
