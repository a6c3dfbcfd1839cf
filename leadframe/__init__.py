"""leadframe: a Spark-native engine for multi-lead signals and the text that goes with them."""
