"""readlake: Spark-native analytics over noisy, clustered sequence reads."""
