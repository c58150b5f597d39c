"""lethewise: Spark-native analytics of what a language model has memorised and what it still knows."""
