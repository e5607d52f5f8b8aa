"""Document, conversation and event analytics expressed as Spark DataFrame jobs."""
