"""veilspark: a Spark-native text privacy and analytics engine."""
