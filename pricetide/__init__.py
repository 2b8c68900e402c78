"""Shopping, quote and training-data jobs on Spark: plain ``DataFrame -> DataFrame`` functions."""
