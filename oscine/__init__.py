"""oscine: Spark-native analytics for multichannel recordings and event streams."""
