"""Image forensics and corpus analytics as Spark jobs."""
