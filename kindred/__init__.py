"""kindred: record linkage and entity resolution as declarative Spark DataFrame transformations."""
