"""obsweave: event-fusion analytics expressed as Spark DataFrame jobs."""
