"""lacunae: a Spark-native engine for time series with gaps and for what the gaps do to forecast evaluation."""
