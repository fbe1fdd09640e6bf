"""gleaner: a Spark-first document-intelligence engine."""
