"""Document similarity and authorship analytics on Spark."""
