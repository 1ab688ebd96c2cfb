"""Ad-performance analytics expressed as Spark DataFrame jobs."""
