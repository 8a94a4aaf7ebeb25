"""Usage analytics over model-call tables, written as Spark DataFrame operators."""
