"""Learning-log and document-corpus analytics as Spark DataFrame jobs."""
