"""A Spark-native engine for dated text, lexicon scores and the statistics built on them."""
