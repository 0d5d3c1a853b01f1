"""Event archives, versioned leaderboards and text ingestion as Spark jobs."""
