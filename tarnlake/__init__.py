"""tarnlake: a memory-retrieval and training-data engine built on the Spark DataFrame API."""
