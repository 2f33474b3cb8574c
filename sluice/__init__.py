"""A Spark-first engine for listing pages: extract, normalise, identify, de-duplicate, remember."""
