"""Academic records analytics on Spark: DataFrame-in, DataFrame-out functions."""
