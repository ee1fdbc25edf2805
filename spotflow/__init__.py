"""spotflow: a Spark-native engine for localization, tracking and clustering data."""
