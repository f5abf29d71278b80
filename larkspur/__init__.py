"""larkspur: a Spark-native recommendation, search and corpus analytics engine."""
