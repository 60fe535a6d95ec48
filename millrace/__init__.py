"""millrace: a Spark-native engine for building, auditing and evaluating text and code corpora."""
