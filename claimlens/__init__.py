"""claimlens: checking generated answers against their sources, as Spark jobs."""
