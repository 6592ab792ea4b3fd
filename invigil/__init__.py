"""invigil: assessment data at scale, as set-at-a-time Spark jobs."""
