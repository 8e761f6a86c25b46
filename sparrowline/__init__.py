"""A Spark-native engine for event data: cleaning, modelling, streaming, quality."""
