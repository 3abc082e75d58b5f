"""Document structuring, note anchoring and corpus preparation as Spark jobs."""
