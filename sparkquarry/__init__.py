"""sparkquarry: a Spark-native analytics engine for source-code and document corpora."""
