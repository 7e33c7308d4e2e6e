"""Speech and audio analytics as Spark jobs."""
