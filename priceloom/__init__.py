"""Product-listing analytics on Spark: DataFrame in, DataFrame out."""
