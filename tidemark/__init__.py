"""tidemark: time-series features, neighbours, datasets and evaluation as Spark DataFrame functions."""
