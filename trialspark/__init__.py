"""Event and trial analytics as Spark jobs."""
