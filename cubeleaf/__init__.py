"""A Spark-native engine for tables with array-valued cells."""
